"""Named report measures over the customer view, for any grouping and filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.labels import THEMES
from ..sources.store import Store
from . import ranks as R


def _n() -> Column:
    return F.count(F.lit(1))  # the view has one row per customer


def _rate(a: Column, b: Column) -> Column:
    return S.fixed(S.ratio(a, b), 6, 10)


def aggregates() -> dict[str, Column]:
    c, n = F.col, _n()
    value = F.sum("total_txn_value")
    high_value = F.sum(F.when(c("is_high_value"), c("total_txn_value")))
    return {
        "total_customers": n, "total_txn_value": value.cast("double"), "total_txns": F.sum("txn_count"),
        "avg_txn_value": S.fixed(S.ratio(value, F.sum("txn_count")), 4),
        "avg_balance": S.fixed(S.mean_of(c("avg_balance")), 4),
        "active_customers": F.count_if("is_active"), "active_rate": _rate(F.count_if("is_active"), n),
        "high_value_customers": F.count_if("is_high_value"), "high_value_share": _rate(F.count_if("is_high_value"), n),
        "high_value_value_share": _rate(high_value, value), "dormant_customers": F.count_if("is_dormant"),
        "txn_frequency": _rate(F.sum("txn_count"), n), "avg_recency_days": _rate(F.sum("recency_days"), n),
        "avg_engagement_score": S.fixed(S.mean_of(c("engagement_score")), 4),
        "opportunity_count": F.count_if("any_signal"), "opportunity_rate": _rate(F.count_if("any_signal"), n),
        "addressable_balance": F.sum(F.when(c("any_signal"), c("latest_balance"))).cast("double"),
        "avg_opportunity_score": S.fixed(S.mean_of(c("overall_score")), 4),
        "tier_a_customers": F.count_if(c("tier") == "A"), "tier_b_customers": F.count_if(c("tier") == "B"),
        **{f"{t}_signals": F.count_if(f"sig_{t}") for t in THEMES}}


def measures(view: DataFrame, by: list[str], names: list[str] | None = None,
             filters: dict[str, str] | None = None) -> DataFrame:
    known = aggregates()
    chosen = names or list(known)
    kept = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), (filters or {}).items(), view)
    return kept.groupBy(*by).agg(*[known[n].alias(n) for n in chosen])


def median_balance(store: Store, name: str, view: DataFrame, by: list[str]) -> DataFrame:
    spread = R.distribution(store, f"median_{name}", view, ["avg_balance"], by=by)
    return R.quantiles(spread, {"median_balance": ("avg_balance", 0.5)}, by)


def segment_shares(view: DataFrame, by: list[str]) -> DataFrame:
    """Share of customers and value per segment; the whole drops only the segment filter, so other groupings stay."""
    sums = view.groupBy("segment_name", *by).agg(_n().alias("n"), F.sum("total_txn_value").alias("v"))
    whole = Window.partitionBy(*by)
    return sums.select("segment_name", *by, S.percent(F.col("n"), F.sum("n").over(whole)).alias("segment_size_pct"),
                       S.percent(F.col("v"), F.sum("v").over(whole)).alias("segment_value_pct"))


def top_city_value(view: DataFrame) -> DataFrame:
    """Largest total of one city."""
    cities = view.groupBy("clean_city").agg(F.sum("total_txn_value").alias("v"))
    return cities.agg(F.max("v").cast("double").alias("top_city_value"))


def daily(daily_city: DataFrame, dates: DataFrame) -> DataFrame:
    sums = daily_city.groupBy("date_key").agg(
        F.sum("txns").alias("daily_txns"), F.sum(F.col("total_value").cast("decimal(38,2)")).cast("double").alias("daily_value"))
    return sums.join(F.broadcast(dates.select("date_key", "date")), "date_key").select("date", "daily_txns", "daily_value")
