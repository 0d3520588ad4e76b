"""Aggregates for reports: daily by city, weekday by hour, city and segment scorecards, themes, KPI rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.labels import THEME_NAMES, THEMES
from ..params import Params
from ..sources.store import Saved, Store
from . import ranks as R


def customer_view(customers: DataFrame, segments: DataFrame, opportunities: DataFrame) -> DataFrame:
    """The three one-row-per-customer tables side by side."""
    scored = opportunities.drop("evidence_level")
    named = segments.select("customer_id", "cluster_key", "segment_id", "segment_name", "layer")
    return customers.join(named.hint("merge"), "customer_id").join(scored.hint("merge"), "customer_id")


def total(value: Column) -> Column:
    return F.sum(value).cast("double")


def addressable() -> Column:
    """Latest balance of customers with a signal."""
    return F.sum(F.when(F.col("any_signal"), F.col("latest_balance"))).cast("double")


def daily_city(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Per day and resolved customer city. Rows are combined per (day, customer) before the join, so a customer with
    very many rows joins once per day and the distinct customers are a plain count."""
    per_day = fact.groupBy("customer_id", "date_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("value"), F.count_if("is_high_value_txn").alias("high"))
    return (per_day.join(customers.select("customer_id", "location_key"), "customer_id")
            .groupBy("date_key", "location_key")
            .agg(F.sum("n").alias("txns"), total(F.col("value")).alias("total_value"),
                 F.sum("high").alias("high_value_txns"), F.count(F.lit(1)).alias("customers")))


def hour_weekday(fact: DataFrame) -> DataFrame:
    number = (F.weekday("txn_date") + 1).alias("day_of_week_num")
    return fact.groupBy(number, "day_of_week", "txn_hour").agg(
        F.count(F.lit(1)).alias("txns"), total(F.col("amount")).alias("total_value"))


def city_summary(store: Store, view: DataFrame) -> DataFrame:
    """City scorecard without UNKNOWN. City text is free, so medians and the value rank are distributed."""
    c = F.col
    known = view.where(c("clean_city") != "UNKNOWN")
    spread = R.distribution(store, "city_balances", known, ["avg_balance"], by=["clean_city"])
    medians = R.quantiles(spread, {"median_avg_balance": ("avg_balance", 0.5)}, ["clean_city"])
    cities = store.save("city_sums", known.groupBy("location_key", "clean_city", "city_tier").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("txn_count").alias("txns"),
        total(c("total_txn_value")).alias("total_value"),
        S.fixed(S.ratio(F.sum("total_txn_value"), F.count(F.lit(1))), 2).alias("value_per_customer"),
        S.fixed(S.mean_of(c("avg_balance")), 2).alias("mean_avg_balance"),
        F.count_if("is_active").alias("active_customers"), F.count_if("is_high_value").alias("high_value_customers"),
        S.fixed(S.mean_of(c("engagement_score")), 2).alias("avg_engagement"),
        F.count_if("any_signal").alias("opportunity_customers"), F.count_if(c("tier") == "A").alias("tier_a"),
        F.count_if(c("tier") == "B").alias("tier_b"), addressable().alias("addressable_balance"))).df
    worth = R.distribution(store, "city_values", cities, ["total_value"])
    placed = R.ranked(cities, "location_key", ["total_value"], worth,
                      {"value_rank": ("total_value", c("total") - c("last") + 1)})
    return cities.join(medians, "clean_city", "left").join(placed, "location_key")


def segment_summary(store: Store, view: DataFrame) -> DataFrame:
    """One row per segment; shares of the total are windows over these few rows."""
    c = F.col
    spread = R.distribution(store, "segment_balances", view, ["avg_balance"], by=["segment_id"])
    medians = R.quantiles(spread, {"median_avg_balance": ("avg_balance", 0.5)}, ["segment_id"])
    every = Window.partitionBy()
    n = F.count(F.lit(1))
    sums = view.groupBy("segment_id", "segment_name").agg(
        n.alias("customers"), S.percent(F.count_if(c("layer") == "Repeat"), n).alias("pct_repeat"),
        total(c("total_txn_value")).alias("total_value"), S.fixed(S.mean_of(c("avg_balance")), 2).alias("mean_avg_balance"),
        S.fixed(S.ratio(F.sum("txn_count"), n), 3).alias("avg_txn_count"),
        S.fixed(S.ratio(F.sum("total_txn_value"), F.sum("txn_count")), 2).alias("avg_txn_value"),
        S.fixed(S.ratio(F.sum("recency_days"), n), 2).alias("avg_recency_days"),
        S.percent(F.count_if("is_active"), n).alias("pct_active"),
        S.percent(F.count_if("is_high_value"), n).alias("pct_high_value"),
        S.percent(F.count_if("any_signal"), n).alias("pct_with_signal"),
        F.count_if(c("tier") == "A").alias("tier_a"))
    return sums.join(medians, "segment_id", "left").withColumns({
        "pct_customers": S.percent(c("customers"), F.sum("customers").over(every)),
        "pct_value": S.percent(c("total_value"),
                               F.sum(c("total_value").cast("decimal(38,2)")).over(every))})


def theme_rows(view: DataFrame, keys: list[str]) -> DataFrame:
    """Six flag columns to one row per theme."""
    flags = [F.struct(F.lit(THEME_NAMES[t]).alias("theme"), F.col(f"sig_{t}").alias("flag")) for t in THEMES]
    return view.select(*keys, "latest_balance", F.inline(F.array(*flags)))


def theme_segment(view: DataFrame) -> DataFrame:
    return theme_rows(view, ["segment_id", "segment_name"]).groupBy("segment_id", "segment_name", "theme").agg(
        F.count_if("flag").alias("flagged_customers"),
        F.sum(F.when(F.col("flag"), F.col("latest_balance"))).cast("double").alias("addressable_balance"))


KPI_ORDER = ("Total Customers", "Total Transactions", "Total Txn Value", "Avg Txn Value", "Avg Balance",
             "Median Balance", "Active Customers", "High Value Customers", "Opportunity Count", "Tier A Customers",
             "Addressable Balance")


def kpis(view: DataFrame, places: Saved) -> DataFrame:
    """The reference KPI rows, from one pass over the customers."""
    c, n = F.col, F.count(F.lit(1))
    median = R.quantiles(places, {"m": ("avg_balance", 0.5)}).scalar()
    values = {
        "Total Customers": n, "Total Transactions": F.sum("txn_count"), "Total Txn Value": F.sum("total_txn_value"),
        "Avg Txn Value": S.fixed(S.ratio(F.sum("total_txn_value"), F.sum("txn_count")), 4),
        "Avg Balance": S.fixed(S.mean_of(c("avg_balance")), 4), "Median Balance": None,
        "Active Customers": F.count_if("is_active"), "High Value Customers": F.count_if("is_high_value"),
        "Opportunity Count": F.count_if("any_signal"), "Tier A Customers": F.count_if(c("tier") == "A"),
        "Addressable Balance": addressable()}
    one = view.agg(*[v.cast("double").alias(k) for k, v in values.items() if v is not None])
    one = one.withColumn("Median Balance", median)
    pairs = [F.struct(F.lit(k).alias("kpi"), c(f"`{k}`").alias("sql_value")) for k in KPI_ORDER]
    return one.select(F.inline(F.array(*pairs)))


def reconcile(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Two computations of (kpi, value) side by side, with variance and status. A KPI that only one side has is kept as
    UNCHECKED. KPI lists are short."""
    variance = S.fixed(F.col("value") - F.col("sql_value"), 4)
    return left.join(right.withColumnRenamed("sql_value", "value"), "kpi", "full").select(
        "kpi", "sql_value", "value", variance.alias("variance"),
        F.when(variance.isNull(), "UNCHECKED").when(F.abs(variance) < tolerance, "PASS").otherwise("CHECK").alias("status"))


def fact_kpis(store: Store, fact: DataFrame, opportunity: DataFrame, p: Params) -> DataFrame:
    """KPIs recomputed from the transactions and the raw ranks, for reconciliation with the customer table."""
    c, n = F.col, F.count(F.lit(1))
    per = store.save("kpi_customers", fact.groupBy("customer_id").agg(
        n.alias("n"), F.sum("amount").alias("value"), S.ratio(F.sum("balance"), F.count("balance")).alias("balance"),
        F.max("txn_date").alias("last_day"),
        F.max_by("balance", F.when(c("balance").isNotNull(), S.latest_first(c("txn_date"), c("txn_sec"), c("txn_seq"), c("transaction_id"))))
        .alias("last_balance"))).df
    one = per.agg(
        n.cast("double").alias("Total Customers"), F.sum("n").cast("double").alias("Total Transactions"),
        F.sum("value").cast("double").alias("Total Txn Value"), S.fixed(S.ratio(F.sum("value"), F.sum("n")), 4).alias("Avg Txn Value"),
        S.fixed(S.mean_of(c("balance")), 4).alias("Avg Balance"),
        F.count_if(F.date_diff(F.lit(p.as_of), c("last_day")) <= p.active_days).cast("double").alias("Active Customers"))
    spread = R.distribution(store, "kpi_balances", per, ["balance", "last_balance", "value"], keep=True)
    median = R.quantiles(spread, {"m": ("balance", 0.5)}).scalar()
    cuts = R.quantiles(spread, {"b": ("last_balance", 0.90), "v": ("value", 0.90)})
    high = per.agg(F.count_if(F.coalesce(c("last_balance").cast("double") >= cuts.select("b").scalar(), F.lit(False))
                              | (c("value").cast("double") >= cuts.select("v").scalar())))
    signalled = opportunity.where("signal_count > 0").select("customer_id").join(per.select("customer_id", "last_balance"), "customer_id")
    ranks = opportunity.agg(n.alias("n"), F.count_if(c("signal_count") > 0).cast("double").alias("signals"))
    tier_a = opportunity.agg(F.count_if(c("priority_rank") <= F.lit(dict(p.tier_cuts)["A"]) * ranks.select("n").scalar()))
    one = one.withColumns({"Median Balance": median, "Opportunity Count": ranks.select("signals").scalar(),
                           "Tier A Customers": tier_a.scalar().cast("double"),
                           "High Value Customers": high.scalar().cast("double"),
                           "Addressable Balance": signalled.agg(total(c("last_balance"))).scalar()})
    pairs = [F.struct(F.lit(k).alias("kpi"), c(f"`{k}`").alias("sql_value")) for k in one.columns]
    return one.select(F.inline(F.array(*pairs)))


def cube_kpis(cube_df: DataFrame, balances: Saved) -> DataFrame:
    """KPIs from the additive measures of a cube. The median is no sum of cells, so it comes from the balances themselves."""
    c = F.col
    exact = lambda x: F.sum(c(x).cast("decimal(38,4)"))
    count = lambda x: F.sum(x).cast("double")
    one = cube_df.agg(
        count("customers").alias("Total Customers"), count("txns").alias("Total Transactions"),
        exact("value").cast("double").alias("Total Txn Value"), S.fixed(S.ratio(exact("value"), exact("txns")), 4).alias("Avg Txn Value"),
        S.fixed(S.ratio(exact("bal_sum"), exact("bal_n")), 4).alias("Avg Balance"), count("active").alias("Active Customers"),
        count("high_value").alias("High Value Customers"), count("any_signal").alias("Opportunity Count"),
        count(F.when(c("tier") == "A", c("customers"))).alias("Tier A Customers"),
        exact("addressable").cast("double").alias("Addressable Balance"))
    one = one.withColumn("Median Balance", R.quantiles(balances, {"m": ("avg_balance", 0.5)}).scalar())
    pairs = [F.struct(F.lit(k).alias("kpi"), c(f"`{k}`").alias("sql_value")) for k in one.columns]
    return one.select(F.inline(F.array(*pairs)))
