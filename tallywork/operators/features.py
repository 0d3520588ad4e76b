"""One row per customer: behaviour features, scores, bands and rule flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Params
from ..sources.store import Saved, Store
from . import ranks as R

RANKED = ["total_txn_value", "avg_balance", "recency_days", "engagement_score", "txn_to_balance_ratio",
          "latest_balance"]


def base(fact: DataFrame, p: Params) -> DataFrame:
    """Aggregates per customer. Rows are combined map-side, so a customer with very many rows costs one partial row per task;
    the distinct days are counted on two narrow columns. Joins of customers are merge joins here and later: each side lies in
    buckets, and no table that grows is sent to the driver. Balance moments are exact decimals, so the deviation does not depend
    on the order of rows."""
    c = F.col
    balance, hour, early = c("balance"), c("txn_hour"), c("txn_date") < F.lit(p.trend_split)
    at = S.latest_first(c("txn_date"), c("txn_sec"), c("txn_seq"), c("transaction_id"))
    last = F.max(F.when(balance.isNotNull(), F.struct(at.alias("at"), balance.alias("balance"))))
    late = (hour >= 17) | (hour < 6)
    days = (fact.groupBy("customer_id", "txn_date").agg(F.lit(1).alias("_day")).groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("active_days")))
    sums = fact.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount").cast("decimal(28,2)").alias("total_txn_value"),
        F.max("amount").alias("max_txn_value"), F.min("amount").alias("min_txn_value"),
        F.min("txn_date").alias("first_txn_date"), F.max("txn_date").alias("last_txn_date"),
        F.sum(balance.cast("decimal(28,2)")).alias("bal_sum"), F.count(balance).alias("balance_obs"),
        F.sum(balance * balance).cast("decimal(38,4)").alias("bal_sq"),
        F.max(balance).alias("max_balance"), F.min(balance).alias("min_balance"), last["balance"].alias("latest_balance"),
        S.ratio(F.count_if(late), F.count(hour)).alias("evening_night_share"),
        F.count_if(early).alias("txns_first_half"), F.count_if(~early).alias("txns_second_half"),
        F.count_if(c("is_high_value_txn")).alias("high_value_txn_count"))
    return sums.join(days.hint("merge"), "customer_id").select(
        "customer_id", "txn_count", "total_txn_value", "max_txn_value", "min_txn_value", "active_days", "first_txn_date",
        "last_txn_date", "bal_sum", "balance_obs", "bal_sq", "max_balance", "min_balance", "latest_balance",
        "evening_night_share", "txns_first_half", "txns_second_half", "high_value_txn_count")


def derived(base_df: DataFrame, p: Params) -> DataFrame:
    """Guarded ratios, recency, trend and the engagement score."""
    c = F.col
    n, days = c("balance_obs"), p.window_days
    squares = (c("bal_sq") * n - c("bal_sum") * c("bal_sum")).cast("double")  # n^2 times the population variance
    avg_balance, avg_value = S.ratio(c("bal_sum"), n), S.ratio(c("total_txn_value"), c("txn_count"))
    recency = F.date_diff(F.lit(p.as_of), c("last_txn_date"))
    deviation = F.when(n >= 2, F.sqrt(squares / (n * (n - 1)).cast("double")))
    fresh = 1 - F.least(c("recency_days"), F.lit(days)).cast("double") / days
    engagement = 100 * (0.5 * F.least(c("txn_count"), F.lit(4)) / 4.0 + 0.3 * fresh
                        + 0.2 * F.least(c("active_days"), F.lit(4)) / 4.0)
    one, two = c("txn_count") == 1, c("txn_count") == 2
    trend = (F.when(one, "Single transaction").when(c("txns_second_half") > c("txns_first_half"), "Rising")
             .when(c("txns_second_half") < c("txns_first_half"), "Declining").otherwise("Stable"))
    return (base_df
            .withColumns({"avg_txn_value": avg_value, "avg_balance": avg_balance, "recency_days": recency,
                          "monthly_txn_frequency": c("txn_count") / F.lit(days / 30.0), "_sd": deviation})
            .withColumns({
                "balance_volatility": F.when((n >= 2) & (c("avg_balance") > 0), c("_sd") / c("avg_balance")),
                "txn_to_balance_ratio": F.when(c("latest_balance") >= 1,
                                               c("avg_txn_value") / c("latest_balance").cast("double")),
                "engagement_score": S.fixed(engagement, 2, inner=10), "activity_trend": trend,
                "freq_band": F.when(one, "Single").when(two, "Repeat").otherwise("Frequent"),
                "evidence_level": F.when(one, "Low").when(two, "Medium").otherwise("High"),
                "is_active": c("recency_days") <= p.active_days, "is_dormant": c("recency_days") > p.dormant_days,
                "is_newly_observed":
                    c("first_txn_date") >= F.date_sub(F.lit(p.as_of), p.newly_observed_days),
                "is_zero_balance": c("latest_balance") < 1})
            .drop("bal_sum", "bal_sq", "_sd"))


def customer_base(store: Store, fact: DataFrame, customers: DataFrame, p: Params) -> Saved:
    """Features with demographics, before anything that needs a rank. Both sides have one row per customer."""
    people = customers.select("customer_id", "age", "age_group", "age_known", "gender", "location_key", "clean_city",
                              "city_tier")
    return store.save_by("customer_id", "customer_base", derived(base(fact, p), p).join(people.hint("merge"), "customer_id"))


def thresholds(dist: Saved, amounts: Saved) -> DataFrame:
    """The seven percentile cut-offs, one row."""
    cuts = R.quantiles(dist, {
        "latest_balance_p90": ("latest_balance", 0.90), "total_txn_value_p90": ("total_txn_value", 0.90),
        "engagement_p25": ("engagement_score", 0.25), "avg_balance_p50": ("avg_balance", 0.50),
        "avg_balance_p75": ("avg_balance", 0.75), "avg_balance_p90": ("avg_balance", 0.90)})
    p95 = R.quantiles(amounts, {"txn_amount_p95": ("amount", 0.95)}).scalar()
    return cuts.withColumn("txn_amount_p95", p95)


def customer_ranks(store: Store, base_df: DataFrame, dist: Saved) -> Saved:
    """Every rank a later stage needs, from one tall pass over the customers."""
    wanted = {
        "pct_total_value": ("total_txn_value", R.percent_rank_of()), "pr_total": ("total_txn_value", R.cume_dist_of()),
        "pct_avg_balance": ("avg_balance", R.percent_rank_of()), "pr_balance": ("avg_balance", R.cume_dist_of()),
        "cd_recency_desc": ("recency_days", R.cume_dist_desc_of()),
        "pr_engagement": ("engagement_score", R.cume_dist_of()),
        "pr_ratio": ("txn_to_balance_ratio", R.cume_dist_of())}
    seen = R.ranked(base_df, "customer_id", RANKED[:-1], dist, wanted)
    # Customers whose balance is unknown are placed by value alone.
    both = 0.5 * F.col("pct_avg_balance") + 0.5 * F.col("pct_total_value")
    return store.save_by("customer_id", "customer_ranks", seen.withColumn("composite", F.coalesce(both, F.col("pct_total_value"))))


def customer_360(store: Store, base_df: DataFrame, ranks: DataFrame, cuts: DataFrame, p: Params) -> Saved:
    c = F.col
    dist = R.distribution(store, "composite", ranks, ["composite"])
    placed = R.ranked(ranks, "customer_id", ["composite"], dist, {"_pct": ("composite", R.percent_rank_of())})
    quintile = lambda x: F.ceil(x * 5).cast("int")
    scored = base_df.join(ranks.hint("merge"), "customer_id").join(placed.hint("merge"), "customer_id")
    scored = scored.withColumns({
        "value_score": S.fixed(100 * c("_pct"), 2, inner=10), "r_score": quintile(c("cd_recency_desc")),
        "f_score": F.least(c("txn_count"), F.lit(5)).cast("int"), "m_score": quintile(c("pr_total"))})
    scored = scored.withColumn("rfm_code", F.concat(c("r_score"), c("f_score"), c("m_score")))
    cut = lambda name: cuts.select(name).scalar()
    full = scored.withColumns({
        "is_high_value": F.coalesce(c("latest_balance").cast("double") >= cut("latest_balance_p90"), F.lit(False))
        | (c("total_txn_value").cast("double") >= cut("total_txn_value_p90")),
        "is_low_engagement": c("engagement_score") < cut("engagement_p25")})
    return store.save_by("customer_id", "customer_360", full.drop("_pct", "composite"))
