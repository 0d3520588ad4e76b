"""The business questions: one function per result set, over a workspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranks as R
from ..operators.skew import lookup_join
from .workspace import Workspace

c = F.col
QUESTIONS: dict[str, tuple[str, Callable[[Workspace], DataFrame]]] = {}


def n_rows():
    return F.count(F.lit(1))


def known_city():
    return F.col("clean_city") != "UNKNOWN"


def question(qid: str, title: str):
    def add(fn):
        QUESTIONS[qid] = (title, fn)
        return fn
    return add


def whole(name: str):
    """Total over an aggregated result of a few rows."""
    return F.sum(name).over(Window.partitionBy())


def ranked_top(df: DataFrame, by: str, tie: str, n: int, name: str) -> DataFrame:
    """The n largest with their rank. A rank depends only on larger rows, which are all among the n."""
    top = df.orderBy(F.desc(by), tie).limit(n)
    return top.withColumn(name, F.rank().over(Window.orderBy(F.desc(by))))


@question("Q01", "Clean transactions and distinct customers")
def q01(w: Workspace) -> DataFrame:
    per = w.fact.groupBy("customer_id").agg(n_rows().alias("n"), F.sum("amount").alias("v"))
    clean = w.waterfall.where("step_no = 99").select("rows").scalar()
    return per.agg(F.sum("n").alias("clean_transactions"), n_rows().alias("distinct_customers"),
                   F.sum("v").cast("double").alias("total_txn_value_inr")).withColumn("waterfall_clean_rows", clean)


@question("Q02", "Rows rejected by reason")
def q02(w):
    return w.waterfall


@question("Q03", "Top 100 customers by transaction value")
def q03(w):
    return ranked_top(w.customer_360.select("customer_id", "clean_city", "txn_count", "total_txn_value",
                                            "latest_balance"), "total_txn_value", "customer_id", 100, "value_rank")


@question("Q04", "Top 100 customers by average balance")
def q04(w):
    rows = w.customer_360.where("avg_balance is not null")
    return ranked_top(rows.select("customer_id", "clean_city", "avg_balance", "latest_balance", "txn_count"),
                      "avg_balance", "customer_id", 100, "balance_rank")


@question("Q05", "Cities with the highest transaction value")
def q05(w):
    cities = w.customer_360.where(known_city()).groupBy("clean_city").agg(
        F.sum("total_txn_value").alias("total_txn_value"), F.sum("txn_count").alias("txns"))
    return ranked_top(cities, "total_txn_value", "clean_city", 25, "city_rank")


@question("Q06", "Cities with the most customers")
def q06(w):
    cities = w.customer_360.where(known_city()).groupBy("clean_city").agg(
        n_rows().alias("customers"), F.sum("total_txn_value").alias("total_txn_value"))
    big = cities.where(c("customers") >= w.params.min_city_customers)
    return big.withColumn("value_per_customer", S.fixed(S.ratio(c("total_txn_value"), c("customers")), 2)) \
        .orderBy(F.desc("customers"), "clean_city").limit(25)


@question("Q07", "Share of high-value transactions")
def q07(w):
    flag = c("is_high_value_txn")
    one = w.fact.agg(S.percent(F.count_if(flag), n_rows()).alias("pct_txns_high_value"),
                     S.percent(F.sum(F.when(flag, c("amount"))), F.sum("amount")).alias("pct_value_high_value"))
    return one.withColumn("p95_amount_inr", w.thresholds.select("txn_amount_p95").scalar())


@question("Q08", "Value deciles of customers with cumulative share")
def q08(w):
    values = w.value_places.df.where("measure = 'total_txn_value'")
    worth = c("value").cast("decimal(38,2)") * c("copies")
    deciles = R.tiles(values, 10, descending=True).groupBy(c("tile").alias("value_decile")).agg(
        F.sum("copies").alias("customers"), F.sum(worth).alias("v"))
    upto = F.sum("v").over(Window.orderBy("value_decile").rowsBetween(Window.unboundedPreceding, 0))  # ten rows
    return deciles.select("value_decile", "customers", c("v").cast("double").alias("decile_value"),
                          S.percent(c("v"), whole("v")).alias("pct_of_value"),
                          S.percent(upto, whole("v")).alias("cumulative_pct"))


@question("Q09", "Ticket size by gender and age group")
def q09(w):
    """Rows of a customer with very many are spread in the join; amounts are counted per gender and age group, and only the
    counts are put into both groupings."""
    people = w.base.of(w.base.df.select("customer_id", "gender", "age_group", "txn_count"))
    rows = lookup_join(w.fact.select("customer_id", "amount"), people, ["customer_id"], "txn_count", c("amount"))
    named = rows.groupBy("gender", "age_group", "amount").agg(n_rows().alias("copies"))
    groups = F.array(*[F.struct(F.lit(d).alias("dimension"), c(d).alias("group_value")) for d in ("gender", "age_group")])
    tall = named.select("amount", "copies", F.inline(groups))
    made = R.weighted_summary(w.store, "ticket", tall, "amount", "copies", ["dimension", "group_value"])
    return made.select("dimension", c("group_value").alias("value"), c("rows").alias("txns"),
                       c("mean_amount").alias("avg_txn_value"), c("median_amount").alias("median_txn_value"))


@question("Q10", "Customers by number of transactions")
def q10(w):
    label = F.when(c("txn_count") >= 3, "3+").otherwise(c("txn_count").cast("string"))
    sizes = w.customer_360.groupBy(label.alias("txns_per_customer")).agg(n_rows().alias("customers"))
    return sizes.withColumn("pct_customers", S.percent(c("customers"), whole("customers")))


def per_day(w) -> DataFrame:
    """One row per day with its calendar columns; the day list is bounded by the window."""
    days = w.fact.groupBy("date_key").agg(n_rows().alias("n"), F.sum("amount").alias("v"))
    return days.join(F.broadcast(w.dim_date), "date_key")


@question("Q11a", "Monthly counts and values")
def q11a(w):
    months = per_day(w).groupBy("month_key", "month_name").agg(
        F.sum("n").alias("txns"), F.sum("v").cast("double").alias("total_value"), n_rows().alias("days_in_window"))
    return months.withColumn("txns_per_day", S.fixed(S.ratio(c("txns"), c("days_in_window")), 0))


@question("Q11b", "Weekly counts and values with a running total")
def q11b(w):
    weeks = per_day(w).groupBy("week_start").agg(
        F.sum("n").alias("txns"), F.sum("v").cast("double").alias("total_value"), n_rows().alias("days_in_week"))
    upto = Window.orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    return weeks.withColumn("running_txns", F.sum("txns").over(upto))


@question("Q12", "Activity by weekday and by time band")
def q12(w):
    weekdays = per_day(w).groupBy(c("day_of_week").alias("value"), c("day_of_week_num").alias("sort_key")).agg(
        F.sum("n").alias("txns"), S.fixed(S.ratio(F.sum("n"), n_rows()), 0).alias("avg_txns_per_day"))
    bands = w.fact.groupBy(c("time_band").alias("value")).agg(
        F.min("txn_hour").alias("sort_key"), n_rows().alias("txns"), F.lit(None).cast("double").alias("avg_txns_per_day"))
    return weekdays.select(F.lit("day_of_week").alias("dimension"), "*").unionByName(
        bands.select(F.lit("time_band").alias("dimension"), "*"))


@question("Q13", "Customers with declining activity")
def q13(w):
    drop = c("txns_first_half") - c("txns_second_half")
    rows = w.customer_360.where("activity_trend = 'Declining'")
    return rows.orderBy(drop.desc(), F.desc("total_txn_value"), "customer_id").limit(100).select(
        "customer_id", "clean_city", "txn_count", "txns_first_half", "txns_second_half", "last_txn_date", "recency_days")


def top_cities(df: DataFrame, measure, n: int) -> DataFrame:
    """Names of the n cities with the largest measure; n rows, so safe to broadcast."""
    sums = df.where(known_city()).groupBy("clean_city").agg(measure.alias("_m"))
    return F.broadcast(sums.orderBy(F.desc("_m"), "clean_city").limit(n).select("clean_city"))


@question("Q14", "Top 3 customers in each top-10 city")
def q14(w):
    """Spark prunes each task to three per city before the shuffle, so a large city stays small."""
    rows = w.customer_360.select("customer_id", "clean_city", "total_txn_value")
    kept = rows.join(top_cities(rows, F.sum("total_txn_value"), 10), "clean_city", "left_semi")
    rank = F.rank().over(Window.partitionBy("clean_city").orderBy(F.desc("total_txn_value")))
    return kept.withColumn("rank_in_city", rank).where("rank_in_city <= 3")


@question("Q15", "Balance deciles")
def q15(w):
    values = w.value_places.df.where("measure = 'avg_balance'")
    deciles = R.tiles(values, 10).groupBy(c("tile").alias("balance_decile"))
    worth = F.sum(c("value").cast("decimal(38,6)") * c("copies"))
    return deciles.agg(F.sum("copies").alias("customers"), F.min("value").alias("min_balance"),
                       F.max("value").alias("max_balance"),
                       S.fixed(S.ratio(worth, F.sum("copies")), 2).alias("mean_balance"))


@question("Q16", "Recency and value score grid")
def q16(w):
    mean = lambda x, k: S.fixed(S.ratio(F.sum(x), n_rows()), k)
    return w.customer_360.groupBy("r_score", "m_score").agg(
        n_rows().alias("customers"), mean("recency_days", 1).alias("avg_recency"), mean("txn_count", 2).alias("avg_txns"),
        mean("total_txn_value", 0).alias("avg_value"))


@question("Q17", "Customers per balance band")
def q17(w):
    sizes = w.customer_360.groupBy(S.balance_band(c("latest_balance")).alias("balance_band")).agg(n_rows().alias("customers"))
    return sizes.withColumn("pct_customers", S.percent(c("customers"), whole("customers")))


@question("Q18", "High balance with low engagement")
def q18(w):
    cut = w.thresholds.select("avg_balance_p75").scalar()
    rows = w.customer_360.where((c("avg_balance") >= cut) & c("is_low_engagement"))
    return rows.orderBy(F.desc("avg_balance"), "customer_id").limit(100).select(
        "customer_id", "clean_city", "avg_balance", "txn_count", "recency_days", "engagement_score")


@question("Q19", "Balances by city tier and in the top-20 cities")
def q19(w):
    rows = w.customer_360.select("city_tier", "clean_city", "avg_balance")
    top = top_cities(rows, n_rows(), 20).select("clean_city", F.lit(True).alias("_top"))
    marked = rows.join(F.broadcast(top), "clean_city", "left")
    groups = F.array(F.struct(F.lit("city_tier").alias("level"), c("city_tier").alias("name")),
                     F.struct(F.lit("top20_city").alias("level"), F.when(c("_top"), c("clean_city")).alias("name")))
    tall = marked.select("avg_balance", F.inline(groups)).where(c("name").isNotNull())
    made = R.weighted_summary(w.store, "group_balances", tall, "avg_balance", None, ["level", "name"], 0)
    unknown = tall.where("avg_balance is null").groupBy("level", "name").agg(n_rows().alias("_unknown"))
    count = F.coalesce("rows", F.lit(0)) + F.coalesce("_unknown", F.lit(0))
    return made.join(unknown, ["level", "name"], "full").select("level", "name", count.alias("customers"), "mean_avg_balance",
                                                                "median_avg_balance")


@question("Q20", "Highest ticket to balance ratio")
def q20(w):
    rows = w.customer_360.where("txn_to_balance_ratio is not null")
    return rows.orderBy(F.desc("txn_to_balance_ratio"), "customer_id").limit(100).select(
        "customer_id", "clean_city", "avg_txn_value", "latest_balance",
        S.fixed(c("txn_to_balance_ratio"), 4, 10).alias("txn_to_balance_ratio"))


@question("Q21", "Share of customers with unknown attributes")
def q21(w):
    return w.dim_customer.agg(
        n_rows().alias("customers"), S.percent(F.count_if(c("dob").isNull()), n_rows()).alias("pct_dob_missing_or_invalid"),
        S.percent(F.count_if(c("gender") == "Unknown"), n_rows()).alias("pct_gender_unknown"),
        S.percent(F.count_if(~known_city()), n_rows()).alias("pct_location_unknown"))


@question("Q22", "Customers with conflicting attributes")
def q22(w):
    flags = ("dob_conflict", "gender_conflict", "location_conflict")
    repeat = w.customer_360.where("txn_count > 1").agg(n_rows()).scalar()
    return w.dim_customer.agg(*[F.count_if(f).alias(f"{f}s") for f in flags],
                              F.count_if(c(flags[0]) | c(flags[1]) | c(flags[2])).alias("any_conflict")) \
        .withColumn("repeat_customers", repeat)


@question("Q23", "Segment size and value")
def q23(w):
    sizes = w.view.groupBy("segment_name").agg(n_rows().alias("customers"), F.sum("total_txn_value").alias("v"),
                                               S.fixed(S.mean_of(c("avg_balance")), 0).alias("mean_avg_balance"))
    return sizes.select("segment_name", "customers", S.percent(c("customers"), whole("customers")).alias("pct_customers"),
                        c("v").cast("double").alias("total_value"), S.percent(c("v"), whole("v")).alias("pct_value"),
                        "mean_avg_balance")


@question("Q24", "Signals by theme and segment with a grand total")
def q24(w):
    names = {"investment": "investment", "premium": "premium_account", "credit_card": "credit_card",
             "insurance": "insurance", "personal_loan": "personal_loan", "reengagement": "reengagement"}
    return w.view.rollup("segment_name").agg(
        *[F.count_if(f"sig_{t}").alias(label) for t, label in names.items()],
        F.count_if("any_signal").alias("any_signal"), n_rows().alias("customers")).orderBy(F.asc_nulls_last("segment_name"))


@question("Q25", "Top 20 tier A customers in the top-5 cities")
def q25(w):
    rows = w.view.where((c("tier") == "A") & known_city()).select("customer_id", "clean_city", "overall_score", "driving_theme")
    kept = rows.join(top_cities(rows, n_rows(), 5), "clean_city", "left_semi")
    place = F.row_number().over(Window.partitionBy("clean_city").orderBy(F.desc("overall_score"), "customer_id"))
    return kept.withColumn("rank_in_city", place).where("rank_in_city <= 20").select(
        "clean_city", "rank_in_city", "customer_id", S.fixed(c("overall_score"), 2).alias("overall_score"), "driving_theme")


@question("Q26", "Cities with many priority customers and low activity")
def q26(w):
    ab = F.count_if(c("tier").isin("A", "B"))
    engagement = S.mean_of(c("engagement_score"))
    cities = w.view.where(known_city()).groupBy("clean_city").agg(
        n_rows().alias("customers"), S.ratio(ab, n_rows()).alias("share"), engagement.alias("engagement"),
        S.ratio(F.sum("txn_count"), n_rows()).alias("txns"))
    every = w.view.agg(S.ratio(ab, n_rows()).alias("share"), engagement.alias("engagement"))
    kept = cities.where((c("customers") >= w.params.min_city_customers)
                        & (c("share") > every.select("share").scalar())
                        & (c("engagement") < every.select("engagement").scalar()))
    return kept.orderBy(F.desc("share"), "clean_city").limit(20).select(
        "clean_city", "customers", S.fixed(100 * c("share"), 2, 10).alias("pct_tier_ab"),
        S.fixed(c("engagement"), 2, 10).alias("avg_engagement"), S.fixed(c("txns"), 3, 10).alias("avg_txns"))
