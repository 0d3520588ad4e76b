"""Customer cubes: additive measures by dimension, slices, ratios, and the priority list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scalars as S
from .reconcile import cells

DIMENSIONS = ("segment_name", "age_group", "gender", "city", "tier", "evidence_level")
WIDE_DIMENSIONS = ("segment_id", "segment_name", "age_group", "gender", "city", "city_tier", "tier", "evidence_level",
                   "balance_band")


def top_values(df: DataFrame, column: str, measure: Column, n: int, skip: str = "UNKNOWN") -> DataFrame:
    """The n values with the largest total, with their place from 0. Ties go to the lower value."""
    totals = df.where(F.col(column) != skip).groupBy(column).agg(measure.alias("_total"))
    top = totals.orderBy(F.desc("_total"), column).limit(n)
    return top.select(column, (F.row_number().over(Window.orderBy(F.desc("_total"), column)) - 1).alias("place"))


def with_city_bucket(df: DataFrame, top: DataFrame, other: str = "Other cities", unknown: str = "Unknown") -> DataFrame:
    """``city``: the city for a top member, else other or unknown. The top list is n rows, so it is broadcast."""
    marked = df.join(F.broadcast(top.select("clean_city", F.lit(True).alias("_top"))), "clean_city", "left")
    label = S.bucket_label(F.col("clean_city"), F.coalesce("_top", F.lit(False)), other, unknown)
    return marked.withColumn("city", label).drop("_top")


def measures() -> list[Column]:
    """The additive measures of the main cube."""
    n = F.count(F.lit(1))
    money = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double")
    exact = F.col("avg_balance").cast("decimal(38,6)")
    return [n.alias("customers"), F.sum("txn_count").alias("txns"), money("total_txn_value").alias("value"),
            S.fixed(F.coalesce(F.sum(exact), F.lit(0)), 2).alias("bal_sum"), F.count("avg_balance").alias("bal_n"),
            money("latest_balance").alias("latest_bal"), F.count_if("is_active").alias("active"),
            F.count_if("is_high_value").alias("high_value"), F.count_if("is_dormant").alias("dormant"),
            F.count_if("any_signal").alias("any_signal"),
            F.coalesce(F.sum(F.when(F.col("any_signal"), F.col("latest_balance"))), F.lit(0)).cast("double")
            .alias("addressable"),
            S.fixed(F.sum(F.col("overall_score").cast("decimal(38,6)")), 3).alias("score_sum"),
            *[F.count_if(f"sig_{t}").alias(f"sig_{t}") for t in L.THEMES]]


def cube(view: DataFrame, top: DataFrame) -> DataFrame:
    return with_city_bucket(view, top).groupBy(*DIMENSIONS).agg(*measures())


def wide_cube(view: DataFrame, top: DataFrame) -> DataFrame:
    banded = with_city_bucket(view, top, "OTHER CITIES", "UNKNOWN").withColumn(
        "balance_band", S.balance_band(F.col("latest_balance")))
    kept = {"bal_sum": "balance_sum", "bal_n": "balance_n"}
    made = banded.groupBy(*WIDE_DIMENSIONS).agg(*measures()).drop("latest_bal", "dormant")
    return made.withColumnsRenamed(kept)


def dictionaries(spark: SparkSession, definitions: DataFrame, top: DataFrame) -> DataFrame:
    """(dim, value, code) for every dimension, in fixed order. All lists are short configuration or the top n."""
    fixed = {"age_group": L.AGE_ORDER, "gender": L.GENDER_ORDER, "tier": L.TIER_ORDER, "evidence": L.EVIDENCE_ORDER}
    rows = [(d, v, i) for d, values in fixed.items() for i, v in enumerate(values)]
    lists = spark.createDataFrame(rows, "dim string, value string, code int")
    by_id = F.row_number().over(Window.orderBy("segment_id")) - 1
    segments = definitions.select(F.lit("segment").alias("dim"), F.col("segment_name").alias("value"), by_id.alias("code"))
    cities = top.select(F.lit("city").alias("dim"), F.col("clean_city").alias("value"), F.col("place").alias("code"))
    count = top.agg(F.count(F.lit(1))).scalar().cast("int")
    rest = spark.range(1).select(F.lit("city").alias("dim"), F.inline(F.array(
        F.struct(F.lit("Other cities").alias("value"), count.alias("code")),
        F.struct(F.lit("Unknown").alias("value"), (count + 1).alias("code")))))
    return reduce(DataFrame.unionByName, (lists, segments, cities, rest))


# The cube column of each dimension.
CUBE_COLUMN = {"segment": "segment_name", "age_group": "age_group", "gender": "gender", "city": "city", "tier": "tier",
               "evidence": "evidence_level"}


def coded(cube_df: DataFrame, codes: DataFrame) -> DataFrame:
    """Cube rows with dimension values replaced by their codes."""
    out = cube_df
    for dim, column in CUBE_COLUMN.items():
        one = codes.where(F.col("dim") == dim).select(F.col("value").alias(column), F.col("code").alias(f"_{dim}"))
        out = out.join(F.broadcast(one), column, "left").drop(column)
    return out.withColumnsRenamed({f"_{dim}": dim for dim in CUBE_COLUMN})


def slice_cube(cube_df: DataFrame, chosen: dict[str, str], but: str | None = None) -> DataFrame:
    """Rows that match every chosen value. ``but`` leaves one dimension unfiltered, so a chart keeps its own axis."""
    wanted = [F.col(CUBE_COLUMN.get(d, d)) == v for d, v in chosen.items() if d != but]
    return reduce(lambda df, test: df.where(test), wanted, cube_df)


def ratios(cube_df: DataFrame, by: list[str]) -> DataFrame:
    """Non-additive measures from additive parts."""
    sums = cube_df.groupBy(*by).agg(*[F.sum(F.col(c).cast("decimal(38,4)")).alias(c) for c in
                                      ("customers", "txns", "value", "bal_sum", "bal_n", "active", "high_value",
                                       "any_signal", "addressable", "score_sum")])
    part = lambda a, b, k=6: S.fixed(S.ratio(F.col(a), F.col(b)), k, 10)
    return sums.select(*by, F.col("customers").cast("bigint").alias("customers"),
                       part("value", "txns", 4).alias("avg_txn_value"), part("bal_sum", "bal_n", 2).alias("avg_balance"),
                       part("txns", "customers").alias("txns_per_customer"), part("active", "customers").alias("active_rate"),
                       part("high_value", "customers").alias("high_value_rate"),
                       part("any_signal", "customers").alias("signal_rate"), part("score_sum", "customers", 3).alias("avg_score"))


def sum_ifs(measure: str, **chosen: str) -> Column:
    """One cell of a sheet: a measure summed over matching cube rows, for use inside an aggregate."""
    test = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in chosen.items()], F.lit(True))
    return F.coalesce(F.sum(F.when(test, F.col(measure))), F.lit(0))


def cross_tab(df: DataFrame, rows: str, columns: str, values, measure: Column, fill: float = 0) -> DataFrame:
    """Row per key, column per listed value; the list is given, so no extra pass finds it."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(measure).na.fill(fill)


def row_shares(tab: DataFrame, columns) -> DataFrame:
    whole = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in columns])
    return tab.select(*[c for c in tab.columns if c not in columns],
                      *[S.percent(F.col(f"`{c}`"), whole).alias(c) for c in columns])


def priority_list(view: DataFrame, n: int) -> DataFrame:
    """The first n customers by priority, masked."""
    c = F.col
    return view.where(c("priority_rank") <= n).select(
        "priority_rank", "masked_id", "tier", S.fixed(c("overall_score"), 1).alias("score"),
        c("driving_theme_label").alias("theme"), "reason", c("clean_city").alias("city"),
        c("segment_name").alias("segment"), c("evidence_level").alias("evidence"), "age_group", "gender",
        F.round("latest_balance", 0).cast("double").alias("latest_balance"), "txn_count", "recency_days")


def filter_priority(rows: DataFrame, top: DataFrame, city: str | None = None, **chosen: str) -> DataFrame:
    """Priority rows for chosen values. 'Other cities' is every known city outside the top list; 'Unknown' is none."""
    out = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), chosen.items(), rows)
    if city == "Other cities":
        names = top.select(F.col("clean_city").alias("city"))
        return out.where(F.col("city") != "UNKNOWN").join(F.broadcast(names), "city", "left_anti")
    if city == "Unknown":
        return out.where(F.col("city") == "UNKNOWN")
    return out if city is None else out.where(F.col("city") == city)


def page(rows: DataFrame, number: int, size: int = 25) -> DataFrame:
    """One page of a priority list, by rank range within the filtered rows; lists are short."""
    place = F.row_number().over(Window.orderBy("priority_rank"))
    return rows.withColumn("_row", place).where(F.col("_row").between(number * size + 1, (number + 1) * size)).drop("_row")


def daily_trend(daily: DataFrame, dates: DataFrame, locations: DataFrame, top: DataFrame) -> DataFrame:
    """Transactions and value per day and city bucket, with a row for every day."""
    cities = with_city_bucket(locations.select("location_key", "clean_city"), top).select("location_key", "city")
    bucketed = daily.join(cities, "location_key").groupBy("city", "date_key").agg(
        F.sum("txns").alias("txns"), F.sum(F.col("total_value").cast("decimal(38,2)")).alias("value"))
    days = dates.select("date_key", "date")
    # Buckets are at most the top list and two more, so the dense frame is small.
    frame = bucketed.select("city").distinct().select("city", F.explode(F.sequence(
        days.agg(F.min("date")).scalar(), days.agg(F.max("date")).scalar())).alias("date"))
    frame = frame.withColumn("date_key", S.date_key(F.col("date")))
    full = frame.join(bucketed, ["city", "date_key"], "left").select(
        "city", "date", F.coalesce("txns", F.lit(0)).alias("txns"),
        F.round(F.coalesce("value", F.lit(0)), 0).cast("double").alias("value"))
    return full


def trend_series(trend: DataFrame) -> DataFrame:
    """One row per bucket with date-ordered lists; a list has one entry per day of the window."""
    rows = F.sort_array(F.collect_list(F.struct("date", "txns", "value")))
    return trend.groupBy("city").agg(rows.alias("_r")).select(
        "city", F.transform("_r", lambda r: r["date"]).alias("dates"), F.transform("_r", lambda r: r["txns"]).alias("txns"),
        F.transform("_r", lambda r: r["value"]).alias("value"))


def lookup_rows(view: DataFrame, n: int, top_by_value: int = 100) -> DataFrame:
    """Customers ranked within n, or among the largest by value."""
    c = F.col
    biggest = view.orderBy(F.desc("total_txn_value"), "customer_id").limit(top_by_value).select(
        "customer_id", F.lit(True).alias("_big"))
    kept = view.join(F.broadcast(biggest), "customer_id", "left").where(
        (c("priority_rank") <= n) | F.coalesce("_big", F.lit(False)))
    return kept.select(
        c("priority_rank").alias("customer_ref"), "masked_id", c("clean_city").alias("city"),
        c("segment_name").alias("segment"), "age_group", "gender", "txn_count",
        c("total_txn_value").cast("double").alias("total_value"), c("latest_balance").cast("double").alias("latest_balance"),
        "recency_days", "tier", S.fixed(c("overall_score"), 2).alias("score"), c("driving_theme_label").alias("theme"),
        "evidence_level")


def tier_a_list(view: DataFrame, n: int = 300) -> DataFrame:
    c = F.col
    return view.where(c("tier") == "A").orderBy("priority_rank").limit(n).select(
        c("priority_rank").alias("customer_ref"), "masked_id", S.fixed(c("overall_score"), 2).alias("score"),
        c("driving_theme_label").alias("theme"), F.round("latest_balance", 0).cast("double").alias("latest_balance"))


def lookup_or(left: DataFrame, right: DataFrame, key: str, columns: list[str], default: str = "n/a") -> DataFrame:
    """Looked-up columns with a default for a missing key. Both lists are bounded report extracts."""
    found = left.join(right.select(key, *columns), key, "left")
    return found.select(*left.columns, *[F.coalesce(F.col(x).cast("string"), F.lit(default)).alias(x) for x in columns])


CELL_MEASURES = ("customers", "txns", "value", "bal_n", "active", "high_value", "any_signal", "addressable")


def cube_cells(cube_df: DataFrame) -> DataFrame:
    """Cells of all grains from the cube."""
    add = {m: F.sum(F.col(m).cast("decimal(38,4)")).cast("double") for m in CELL_MEASURES}
    return cells(cube_df, DIMENSIONS, add)


def customer_cells(view: DataFrame, top: DataFrame) -> DataFrame:
    """The same cells from the customers, apart from the cube."""
    c, double = F.col, lambda x: x.cast("double")
    known = F.when(c("any_signal"), c("latest_balance"))
    return cells(with_city_bucket(view, top), DIMENSIONS, {
        "customers": double(F.count(F.lit(1))), "txns": double(F.sum("txn_count")), "value": double(F.sum("total_txn_value")),
        "bal_n": double(F.count("avg_balance")), "active": double(F.count_if("is_active")),
        "high_value": double(F.count_if("is_high_value")), "any_signal": double(F.count_if("any_signal")),
        "addressable": double(F.coalesce(F.sum(known), F.lit(0)))})
