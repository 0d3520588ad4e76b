"""Data-quality scorecard: 24 checks with pass rate, threshold and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import scalars as S
from ..params import Params

# Fixed values: (check, dimension, threshold in percent or None for information).
CHECKS = (
    ("DQ-01", "Completeness", 100.0, "Staging rows equal the expected rows"),
    ("DQ-02", "Accuracy", 100.0, "Raw less rejected equals clean"),
    ("DQ-03", "Completeness", 100.0, "Customer, amount and date present"),
    ("DQ-04", "Completeness", 99.0, "Birth date usable"),
    ("DQ-05", "Completeness", 99.0, "Gender known"),
    ("DQ-06", "Completeness", 99.0, "Location known"),
    ("DQ-07", "Completeness", 99.0, "Balance known"),
    ("DQ-08", "Accuracy", 100.0, "Customer table agrees with transactions"),
    ("DQ-09", "Accuracy", 100.0, "Sampled transactions agree with their raw text"),
    ("DQ-10", "Consistency", 100.0, "Gender in its domain"),
    ("DQ-11", "Consistency", 100.0, "Customer city exists"),
    ("DQ-12", "Consistency", 100.0, "One row per customer"),
    ("DQ-13", "Uniqueness", 100.0, "Transaction id unique"),
    ("DQ-14", "Uniqueness", 100.0, "One feature row per customer"),
    ("DQ-15", "Validity", 99.9, "Amount, balance and date in range"),
    ("DQ-16", "Validity", 100.0, "Age in range or unknown"),
    ("DQ-17", "Validity", None, "Rows rejected"),
    ("DQ-18", "Timeliness", 100.0, "As-of date follows the window"),
    ("DQ-19", "Consistency", None, "Customers with conflicting attributes"),
    ("DQ-20", "Consistency", None, "Repeat customers with agreeing attributes"),
    ("DQ-21", "Uniqueness", None, "Possible copies under other ids"),
    ("DQ-22", "Validity", None, "Zero balance rows"),
    ("DQ-23", "Consistency", None, "Raw location texts merged into cities"),
    ("DQ-24", "Validity", 100.0, "Time of day valid"),
)
SPOT_ROWS = 50


def _duplicates(df: DataFrame, key: str) -> Column:
    """Rows beyond the first per key, as a scalar."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()


def _side_by_side(singles: list[DataFrame]) -> DataFrame:
    """Single-row frames as one row: turned into (name, value) rows, stacked, and picked apart again."""
    tall = [one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("decimal(38,2)").alias("value"))
                                          for k in one.columns]))) for one in singles]
    stacked = reduce(DataFrame.unionByName, tall)
    return stacked.agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k)
                         for one in singles for k in one.columns])


def spot_check(fact: DataFrame, classified: DataFrame, rows: int = SPOT_ROWS) -> DataFrame:
    """The transactions with the lowest id digests beside their raw text; the sample is a fixed few rows, broadcast. The
    raw amount is cast on its own, not by the parser that is being checked."""
    sample = fact.orderBy(F.md5("transaction_id"), "transaction_id").limit(rows).select(
        F.col("transaction_id").alias("txn_id"), "customer_id", F.col("amount").alias("kept_amount"),
        F.col("txn_date").alias("kept_date"))
    raw = classified.select("txn_id", "cust_id", F.trim("transaction_date").alias("day_text"),
                            F.trim("transaction_amount").try_cast("double").cast("decimal(18,2)").alias("raw_amount"))
    shown = F.date_format("kept_date", "d/M/yy")
    same = ((F.col("kept_amount") == F.col("raw_amount")) & (F.col("customer_id") == F.col("cust_id"))
            & (shown == F.col("day_text")))
    return raw.join(F.broadcast(sample), "txn_id").select(
        F.col("txn_id").alias("transaction_id"), "kept_amount", "raw_amount", "day_text", same.alias("matches"))


def measured(spark: SparkSession, classified: DataFrame, fact: DataFrame, customers: DataFrame, locations: DataFrame,
             c360: DataFrame, p: Params) -> DataFrame:
    """(check_id, checked_rows, failed_rows): one aggregate per table, joined as single rows."""
    c, n = F.col, F.count(F.lit(1))
    raw = classified.agg(n.alias("raw"), F.count("reject_reason").alias("rejected"))
    raw = raw.withColumn("spellings", classified.groupBy("cust_location").count().where(
        c("cust_location").isNotNull()).agg(F.count(F.lit(1))).scalar())
    bad_range = (c("amount") <= 0) | (c("balance") < 0) | ~c("txn_date").between(F.lit(p.window_start),
                                                                                 F.lit(p.window_end))
    rows = fact.agg(
        n.alias("txns"), F.sum("amount").alias("value"),
        F.count_if(c("customer_id").isNull() | c("amount").isNull() | c("txn_date").isNull()).alias("keys_null"),
        F.count_if(c("dob").isNull()).alias("no_dob"), F.count_if(c("gender") == "Unknown").alias("no_gender"),
        F.count_if(c("clean_city") == "UNKNOWN").alias("no_city"), F.count_if(c("balance").isNull()).alias("no_balance"),
        F.count_if(F.coalesce(bad_range, F.lit(False))).alias("bad_range"),
        F.count_if("is_possible_duplicate").alias("copies"),
        F.count_if("is_zero_balance").alias("zero_balance"), F.count_if("time_invalid").alias("bad_time"))
    rows = rows.withColumn("repeated_ids", _duplicates(fact, "transaction_id"))
    per = fact.groupBy("customer_id", "dob", "gender", "clean_city").agg(n.alias("n")).groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.count_distinct("dob").alias("d"), F.count_distinct("gender").alias("g"),
        F.count_distinct("clean_city").alias("l"))
    repeat = per.agg(F.count_if(c("n") > 1).alias("repeat"), n.alias("fact_customers"),
                     F.count_if((c("n") > 1) & ((c("d") > 1) | (c("g") > 1) | (c("l") > 1))).alias("disagree"))
    conflict = c("dob_conflict") | c("gender_conflict") | c("location_conflict")
    people = customers.agg(
        n.alias("people"), F.count_if(~c("gender").isin("M", "F", "Unknown")).alias("odd_gender"),
        F.count_if(~c("age").between(p.min_age, p.max_age)).alias("odd_age"), F.count_if(conflict).alias("conflicts"))
    lost = customers.groupBy("location_key").agg(n.alias("n")).join(locations, "location_key", "left_anti")
    people = people.withColumn("orphans", lost.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()) \
        .withColumn("repeated_people", _duplicates(customers, "customer_id"))
    features = c360.agg(n.alias("features"), F.sum("txn_count").alias("feature_txns"),
                        F.sum("total_txn_value").alias("feature_value"))
    features = features.withColumn("repeated_features", _duplicates(c360, "customer_id"))
    spot = spot_check(fact, classified).agg(F.count_if(~F.coalesce("matches", F.lit(False))).alias("spot_bad"))
    one = _side_by_side([raw, rows, repeat, people, features, spot, locations.agg(n.alias("cities"))])
    wrong = lambda a, b: (c(a) != c(b)).cast("int")
    expected = F.lit(p.expected_rows) if p.expected_rows is not None else c("raw")
    on_time = F.lit(0 if (p.as_of - p.window_end).days == 1 else 1)
    pairs = {
        "DQ-01": (expected, F.abs(expected - c("raw"))),
        "DQ-02": (c("raw"), F.abs(c("raw") - c("rejected") - c("txns"))),
        "DQ-03": (c("txns"), c("keys_null")), "DQ-04": (c("txns"), c("no_dob")), "DQ-05": (c("txns"), c("no_gender")),
        "DQ-06": (c("txns"), c("no_city")), "DQ-07": (c("txns"), c("no_balance")),
        "DQ-08": (F.lit(3), wrong("fact_customers", "features") + wrong("txns", "feature_txns")
                  + wrong("value", "feature_value")),
        "DQ-09": (F.lit(SPOT_ROWS), c("spot_bad")), "DQ-10": (c("people"), c("odd_gender")),
        "DQ-11": (c("people"), c("orphans")), "DQ-12": (c("people"), c("repeated_people")),
        "DQ-13": (c("txns"), c("repeated_ids")), "DQ-14": (c("features"), c("repeated_features")),
        "DQ-15": (c("txns"), c("bad_range")), "DQ-16": (c("people"), c("odd_age")),
        "DQ-17": (c("raw"), c("rejected")), "DQ-18": (F.lit(1), on_time), "DQ-19": (c("people"), c("conflicts")),
        "DQ-20": (c("repeat"), c("disagree")), "DQ-21": (c("txns"), c("copies")),
        "DQ-22": (c("txns"), c("zero_balance")), "DQ-23": (c("spellings"), c("spellings") - c("cities")),
        "DQ-24": (c("txns"), c("bad_time"))}
    lines = [F.struct(F.lit(k).alias("check_id"), a.cast("bigint").alias("checked_rows"),
                      b.cast("bigint").alias("failed_rows")) for k, (a, b) in pairs.items()]
    return one.select(F.inline(F.array(*lines)))


def scorecard(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Adds dimension, rule, rounded pass rate and status; the status reads the unrounded rate."""
    rules = spark.createDataFrame(list(CHECKS), "check_id string, dimension string, threshold_pct double, rule string")
    rate = S.ratio(F.col("checked_rows") - F.col("failed_rows"), F.col("checked_rows")) * 100
    return counts.join(F.broadcast(rules), "check_id").select(
        "check_id", "dimension", "rule", "checked_rows", "failed_rows", S.fixed(rate, 3, inner=10).alias("pass_pct"),
        "threshold_pct", F.when(F.col("threshold_pct").isNull(), "INFO")
        .when(rate >= F.col("threshold_pct"), "PASS").otherwise("EXCEPTION").alias("status"),
        F.concat(F.col("failed_rows").cast("string"), F.lit(" of "), F.col("checked_rows").cast("string")).alias("note"))
