"""Staging rows to typed rows with the first rule each one fails, and to clean transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.labels import REJECT_ORDER
from ..params import Params
from ..sources.staging import RAW_COLUMNS
from ..sources.store import Saved, Store
from .skew import lookup_join, repeated_keys

COPY_KEYS = ("customer_id", "dob", "gender", "clean_city", "balance", "txn_date", "txn_sec", "amount")


def typed(staging: DataFrame, p: Params) -> DataFrame:
    """Parsed columns beside the raw text. The turned dates are a projection of their own, so each regex runs once."""
    c = F.col
    staging = staging.select("src_row", *RAW_COLUMNS, P.turned_dmy(c("transaction_date")).alias("_day"),
                             P.turned_dmy(c("customer_dob")).alias("_dob"))
    return staging.select(
        "src_row", *RAW_COLUMNS,
        F.trim(c("transaction_id")).alias("txn_id"), F.trim(c("customer_id")).alias("cust_id"),
        P.turned_date(c("transaction_date"), c("_day"), p.txn_year_pivot).alias("txn_date"),
        P.turned_date(c("customer_dob"), c("_dob"), p.dob_year_pivot).alias("dob_parsed"),
        P.parse_hhmmss(c("transaction_time")).alias("txn_sec"),
        P.to_money(c("transaction_amount")).alias("amount"),
        P.to_money(c("cust_account_balance")).alias("balance_parsed"),
        P.norm_location(c("cust_location")).alias("location_norm"))


def mark_repeats(store: Store, rows: DataFrame, staging: DataFrame) -> DataFrame:
    """Adds ``is_repeat``: a row whose id occurred on an earlier row. Ids are counted on the two columns that needs,
    and only repeated ones are joined back."""
    key = F.nullif(F.col("txn_id"), F.lit(""))  # a blank id is no key: its rows never meet in one task
    named = staging.select("src_row", F.trim("transaction_id").alias("txn_id")).withColumn("_id", key).where("_id is not null")
    repeated = repeated_keys(store, "repeated_ids", named, {"_id": F.col("_id")}, {"first_row": F.min("src_row")})
    marked = lookup_join(rows.withColumn("_id", key), repeated, ["_id"], "n", F.xxhash64("src_row"))
    return marked.withColumn("is_repeat", F.coalesce(F.col("src_row") > F.col("first_row"), F.lit(False))) \
        .drop("first_row", "_id")


def rules(p: Params) -> list[tuple[str, Column]]:
    """Ordered (reason, failed) pairs; the first that holds names the reject."""
    c = F.col
    day, amount = c("txn_date"), c("amount")
    failed = {
        "MISSING_TRANSACTION_ID": F.coalesce(c("txn_id"), F.lit("")) == "",
        "DUPLICATE_TRANSACTION_ID": c("is_repeat"),
        "INVALID_CUSTOMER_ID": ~P.valid_customer_id(c("cust_id")),
        "INVALID_TRANSACTION_DATE": day.isNull(),
        "PARTIAL_COVERAGE_PERIOD": (day > F.lit(p.window_end)) & (day <= F.lit(p.extract_end)),
        "DATE_OUTSIDE_WINDOW": ~day.between(F.lit(p.window_start), F.lit(p.window_end)),
        "MISSING_OR_INVALID_AMOUNT": amount.isNull() & ~P.is_number(c("transaction_amount")),
        "NEGATIVE_AMOUNT": amount < 0,
        "ZERO_AMOUNT": amount == 0,
        "AMOUNT_OUT_OF_RANGE": P.rounded_money(amount).isNull(),  # a number, but more than can be kept
    }
    return [(reason, failed[reason]) for reason in REJECT_ORDER]


def first_failing(pairs: list[tuple[str, Column]]) -> Column:
    chain = F
    for label, failed in pairs:
        chain = chain.when(failed, F.lit(label))
    return chain


def classify(store: Store, staging: DataFrame, p: Params) -> Saved:
    """Every staging row typed, with its reject reason. One file per task: folders by reason would multiply files."""
    rows = mark_repeats(store, typed(staging, p), staging)
    return store.save("classified", rows.withColumn("reject_reason", first_failing(rules(p))))


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNotNull()).select("src_row", *RAW_COLUMNS, "reject_reason")


def clean(classified: DataFrame, variants: DataFrame, p: Params) -> DataFrame:
    """Kept rows with row-level fixes and quality flags. The variant list is the caller's own, so it is broadcast: Spark does
    not know its size and would deal all rows by their city. The rules have seen money as written; from here on it has two
    places."""
    c = F.col
    gender = F.upper(F.trim(c("cust_gender")))
    raw_dob = F.lower(F.trim(c("customer_dob")))
    early, late = c("dob_parsed") < F.lit(p.min_dob), c("dob_parsed") > c("txn_date")
    kept = classified.where(c("reject_reason").isNull()).join(
        F.broadcast(variants.withColumnRenamed("variant", "location_norm")), "location_norm", "left")
    return kept.select(
        "src_row", c("txn_id").alias("transaction_id"), P.id_number(c("txn_id")).alias("txn_seq"),
        c("cust_id").alias("customer_id"), "txn_date", "txn_sec", P.rounded_money(c("amount")).alias("amount"),
        F.when(c("balance_parsed") >= 0, P.rounded_money(c("balance_parsed"))).alias("balance"),
        F.when(~early & ~late, c("dob_parsed")).alias("dob"),
        F.when(gender.isin("M", "F"), gender).otherwise("Unknown").alias("gender"),
        F.coalesce(c("clean_city"), c("location_norm"), F.lit("UNKNOWN")).alias("clean_city"),
        c("cust_location").alias("raw_location"),
        (raw_dob.isNull() | raw_dob.isin("", "nan")).alias("dob_missing"),
        early.alias("dob_placeholder"), late.alias("dob_future"),
        c("balance_parsed").isNull().alias("balance_missing"), (c("balance_parsed") < 0).alias("balance_negative"),
        (c("transaction_time").isNotNull() & c("txn_sec").isNull()).alias("time_invalid"),
        (~F.coalesce(gender, F.lit("")).isin("M", "F", "")).alias("gender_other_value"))


def mark_copies(store: Store, rows: DataFrame) -> DataFrame:
    """Adds ``is_possible_duplicate``: the same business columns under another id, NULLs equal. The columns are
    compared as one digest, so the join has a single never-null key."""
    digest = F.unhex(F.sha2(F.to_json(F.struct(*COPY_KEYS)), 256))
    keyed = rows.withColumn("_copy", digest)
    groups = repeated_keys(store, "copies", keyed, {"_copy": F.col("_copy")}, {"_copied": F.lit(True)})
    marked = lookup_join(keyed, groups, ["_copy"], "n", F.col("transaction_id"))
    return marked.withColumn("is_possible_duplicate", F.coalesce("_copied", F.lit(False))).drop("_copy", "_copied")


def waterfall(classified: DataFrame) -> DataFrame:
    """Raw rows, minus each present reject in rule order, to clean rows. One pass; one count a reason."""
    counts = classified.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(r) for r in REJECT_ORDER]), F.col("reject_reason"))
    reasons = F.sort_array(F.collect_list(F.when(F.col("reject_reason").isNotNull(), F.struct(
        place.alias("at"), F.col("reject_reason").alias("reason"), F.col("n")))))
    one = counts.agg(F.sum("n").alias("raw"),
                     F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0)).alias("clean"),
                     reasons.alias("reasons"))
    step = lambda no, name, n: F.struct(no.cast("int").alias("step_no"), name.alias("step"),
                                        n.cast("bigint").alias("rows"))
    middle = F.transform("reasons", lambda r, i: step(i + 11, F.concat(F.lit("Rejected: "), r["reason"]), -r["n"]))
    steps = F.concat(F.array(step(F.lit(0), F.lit("Raw rows in staging"), F.col("raw"))), middle,
                     F.array(step(F.lit(99), F.lit("Clean rows"), F.col("clean"))))
    return one.select(F.inline(steps))
