"""Profiles of the raw log, before any cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Params
from ..sources.staging import RAW_COLUMNS
from ..sources.store import Store
from . import ranks

# Texts that mean "no value", and the quantile points.
MISSING_TEXT = ("", "nan")
QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def present(column: str) -> Column:
    text = F.col(column)
    return F.when(~text.isin(*MISSING_TEXT), text)


def columns(raw: DataFrame) -> DataFrame:
    """Nulls, null share, distinct values and an example per column. Values are counted per (column, value) first, so a
    value that fills a third of the log costs one row per task."""
    cells = [F.struct(F.lit(c).alias("column_name"), present(c).alias("value")) for c in RAW_COLUMNS]
    tall = raw.select(F.inline(F.array(*cells)))
    counts = tall.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    return counts.groupBy("column_name").agg(
        nulls.alias("nulls"), S.percent(nulls, F.sum("n"), 3).alias("null_pct"),
        F.count("value").alias("distinct_values"), F.min("value").alias("example"))


def money_quantiles(store: Store, classified: DataFrame) -> DataFrame:
    """Ten exact quantiles of amount and balance."""
    rows = classified.select("amount", F.col("balance_parsed").alias("balance"))
    dist = ranks.distribution(store, "raw_money", rows, ["amount", "balance"])
    wanted = {f"{m}_{i}": (m, q) for m in ("amount", "balance") for i, q in enumerate(QUANTILES)}
    one = ranks.quantiles(dist, wanted)
    lines = [F.struct(F.lit(q).alias("quantile"), F.col(f"amount_{i}").alias("amount"),
                      F.col(f"balance_{i}").alias("balance")) for i, q in enumerate(QUANTILES)]
    return one.select(F.inline(F.array(*lines)))


def money_counters(classified: DataFrame) -> DataFrame:
    a, b = F.col("amount"), F.col("balance_parsed")
    return classified.agg(
        F.count_if(a == 0).alias("amount_zero"), F.count_if(a < 0).alias("amount_negative"),
        F.count_if(b == 0).alias("balance_zero"), F.count_if(b < 1).alias("balance_below_one"),
        F.count_if(b < 0).alias("balance_negative"),
        S.percent(F.count_if(b == 0), F.count(F.lit(1)), 3).alias("balance_zero_pct"))


def date_validity(classified: DataFrame) -> DataFrame:
    day, placeholder = F.col("txn_date"), F.col("customer_dob") == "1/1/1800"
    clock = F.trim("transaction_time").try_cast("bigint")
    return classified.agg(
        F.count_if(day.isNull()).alias("date_unparsed"), F.min(day).alias("date_min"), F.max(day).alias("date_max"),
        F.count_if(placeholder).alias("dob_placeholder"),
        S.percent(F.count_if(placeholder), F.count(F.lit(1))).alias("dob_placeholder_pct"),
        F.min(clock).alias("time_min"), F.max(clock).alias("time_max"),
        F.count_if((F.floor(clock / 10000) >= 24) | (F.floor(clock / 100) % 100 >= 60) | (clock % 100 >= 60)).alias("time_invalid"))


def daily_counts(days: DataFrame, spine: DataFrame) -> DataFrame:
    """Rows per calendar day with zeros for empty days."""
    counts = days.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    return spine.join(counts, "date", "left").select("date", F.coalesce("rows", F.lit(0)).alias("rows"))


def log_days(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(day per row, calendar from the first to the last day in the log)."""
    days = classified.where(F.col("txn_date").isNotNull()).select(F.col("txn_date").alias("date"))
    ends = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return days, ends.select(F.explode(F.sequence("lo", "hi")).alias("date"))


def coverage_break(daily: DataFrame, p: Params) -> DataFrame:
    """Coverage inside the window against the tail after it."""
    inside = F.col("date").between(F.lit(p.window_start), F.lit(p.window_end))
    after = F.col("date") > F.lit(p.window_end)
    rows = F.col("rows")
    tail = F.coalesce(F.sum(F.when(after, rows)), F.lit(0))
    return daily.agg(
        F.count_if(inside & (rows == 0)).alias("empty_days_inside"),
        S.fixed(S.ratio(F.sum(F.when(inside, rows)), F.count_if(inside)), 2).alias("mean_rows_inside"),
        F.count_if(after & (rows > 0)).alias("days_after_with_rows"), tail.alias("rows_after"),
        S.percent(tail, F.sum(rows)).alias("pct_rows_after"))


def per_customer(raw: DataFrame) -> DataFrame:
    """How many customers have 1, 2, 3 ... rows."""
    sizes = raw.groupBy("customer_id").agg(F.count(F.lit(1)).alias("txns"))
    dist = sizes.groupBy("txns").agg(F.count(F.lit(1)).alias("customers"))
    whole = F.sum("customers").over(Window.partitionBy())
    return dist.select("txns", "customers", S.percent(F.col("customers"), whole).alias("pct_customers"))


def conflicts(raw: DataFrame) -> DataFrame:
    """Share of repeat ids whose birth date, gender or location text differs between rows."""
    kept = raw.select("customer_id", *[present(c).alias(c) for c in ("customer_dob", "cust_gender", "cust_location")])
    combos = kept.groupBy("customer_id", "customer_dob", "cust_gender", "cust_location").agg(F.count(F.lit(1)).alias("n"))
    ids = combos.groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.count_distinct("customer_dob").alias("d"), F.count_distinct("cust_gender").alias("g"),
        F.count_distinct("cust_location").alias("l")).where("n > 1")
    n, c = F.count(F.lit(1)), F.col
    rate = lambda test: S.percent(F.count_if(test), n, 1)
    return ids.agg(n.alias("repeat_ids"), rate(c("d") > 1).alias("pct_dob"), rate(c("g") > 1).alias("pct_gender"),
                   rate(c("l") > 1).alias("pct_location"),
                   rate((c("d") <= 1) & (c("g") <= 1) & (c("l") <= 1)).alias("pct_consistent"))


def gender_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy(present("cust_gender").alias("cust_gender")).agg(F.count(F.lit(1)).alias("rows"))


def location_counts(classified: DataFrame) -> DataFrame:
    """Distinct location texts before and after normalisation."""
    pairs = classified.select(present("cust_location").alias("raw"), "location_norm").distinct()
    return pairs.agg(F.count_distinct("raw").alias("raw_locations"),
                     F.count_distinct("location_norm").alias("normalised_locations"))


def observed(classified: DataFrame, profile: DataFrame) -> DataFrame:
    """(item, observed): the headline facts of a log as text. Each input is read once."""
    c = F.col
    repeated = F.count_if(c("reject_reason") == "DUPLICATE_TRANSACTION_ID")
    one = classified.agg(F.count(F.lit(1)).alias("rows"), F.min("txn_date").alias("lo"), F.max("txn_date").alias("hi"),
                         F.when(F.coalesce(repeated, F.lit(0)) == 0, "yes").otherwise("no").alias("unique"))
    items = {"Rows": c("rows"), "Columns": F.lit(len(RAW_COLUMNS)), "Transaction id unique": c("unique"),
             "First date": c("lo"), "Last date": c("hi")}
    facts = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), v.cast("string").alias("observed"))
                                          for k, v in items.items()])))
    gaps = ("customer_dob", "cust_gender", "cust_account_balance", "cust_location")
    ids = c("column_name") == "customer_id"
    seen = profile.where(ids | c("column_name").isin(*gaps)).select(
        F.when(ids, "Unique customers").otherwise(F.concat(F.lit("Missing "), c("column_name"))).alias("item"),
        F.when(ids, c("distinct_values")).otherwise(c("nulls")).cast("string").alias("observed"))
    return facts.unionByName(seen)


def compare(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Expected against observed (item, value) lists, which are short."""
    return seen.join(expected, "item", "left").select(
        "item", "expected", "observed", F.when(F.col("expected").isNull(), "no expectation")
        .when(F.col("expected") == F.col("observed"), "yes").otherwise("no").alias("match"))
