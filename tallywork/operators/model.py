"""Star model: dates, locations, transactions and customers with conflicting attributes resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.labels import WEEKDAYS
from ..params import Params
from ..sources.store import Saved, Store
from .ranks import distribution, quantiles, row_numbers
from .skew import lookup_join


def date_spine(spark: SparkSession, start, end) -> DataFrame:
    """One row per day of a closed range."""
    days = F.sequence(F.lit(start), F.lit(end))
    return spark.range(1).select(F.explode(days).alias("date"))


def dim_date(spark: SparkSession, p: Params) -> DataFrame:
    d = F.col("date")
    number = F.weekday(d) + 1
    return date_spine(spark, p.window_start, p.window_end).select(
        S.date_key(d).alias("date_key"), "date", F.year(d).alias("year"), F.month(d).alias("month"),
        F.date_format(d, "MMM yyyy").alias("month_name"), F.date_format(d, "yyyy-MM").alias("month_key"),
        F.trunc(d, "week").alias("week_start"), F.weekofyear(d).alias("iso_week"), weekday_name(d).alias("day_of_week"),
        number.alias("day_of_week_num"), (number > 5).alias("is_weekend"),
        F.date_diff(F.lit(p.as_of), d).alias("days_before_as_of"))


def weekday_name(day):
    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(day) + 1)


def dim_location(store: Store, clean: DataFrame, p: Params) -> Saved:
    """One row per city, keyed by name order. City text is free, so its numbering is a distributed sort.
    Counted per (city, raw text) first: a hot city crosses the shuffle as its distinct spellings only."""
    spellings = clean.groupBy("clean_city", "raw_location").agg(F.count(F.lit(1)).alias("n"))
    cities = spellings.groupBy("clean_city").agg(
        F.count("raw_location").cast("int").alias("raw_variants_count"), F.sum("n").alias("txns"))
    named = store.save("cities", cities)
    numbered = row_numbers(store, "cities_sorted", named, [F.col("clean_city")], "location_key")
    return store.save("dim_location", numbered.select(
        F.col("location_key").cast("int"), "clean_city", "raw_variants_count",
        S.city_tier(F.col("clean_city"), p.tier_1_metros, p.metro_satellites).alias("city_tier"), "txns"))


def amount_distribution(store: Store, clean: DataFrame) -> Saved:
    return distribution(store, "amounts", clean, ["amount"])


def fact(clean: DataFrame, locations: Saved, amounts: Saved) -> DataFrame:
    """Clean rows with derived keys and bands, and the high-value flag against the exact P95 amount."""
    c = F.col
    hour = F.floor(c("txn_sec") / 3600).cast("int")
    p95 = quantiles(amounts, {"p95": ("amount", 0.95)}).scalar()
    places = locations.of(locations.df.select("clean_city", c("location_key").alias("txn_location_key"), "txns"))
    return lookup_join(clean, places, ["clean_city"], "txns", c("transaction_id")).select(
        "*", S.order_key(c("txn_date"), c("txn_sec"), c("txn_seq")).alias("order_key"),
        S.date_key(c("txn_date")).alias("date_key"), hour.alias("txn_hour"), S.time_band(hour).alias("time_band"),
        weekday_name(c("txn_date")).alias("day_of_week"), S.amount_band(c("amount")).alias("amount_band"),
        S.balance_band(c("balance")).alias("balance_band"),
        (c("amount").cast("double") >= p95).alias("is_high_value_txn"), (c("balance") < 1).alias("is_zero_balance"))


# The text that stands for "no value" in each resolved attribute.
ATTRIBUTES = {"dob": None, "gender": "Unknown", "clean_city": "UNKNOWN"}


def _when() -> Column:
    return S.latest_first(*(F.col(x) for x in ("txn_date", "txn_sec", "txn_seq", "transaction_id")))


def most_frequent(rows: DataFrame, attribute: str, missing: str | None) -> DataFrame:
    """(customer, value, n_values): the most frequent value per customer, ties to the latest row. Both levels combine
    map-side, so a customer with very many rows costs one partial row per distinct value and task."""
    value = F.col(attribute)
    kept = rows.where(value.isNotNull() if missing is None else value != missing)
    per_value = kept.groupBy("customer_id", attribute).agg(
        F.count(F.lit(1)).alias("n"), F.max(_when()).alias("latest"))
    return per_value.groupBy("customer_id").agg(
        F.max_by(attribute, F.struct("n", "latest")).alias(attribute), F.count(F.lit(1)).alias(f"{attribute}_values"))


def resolved_attributes(rows: DataFrame) -> DataFrame:
    """All attributes in one pass: rows are counted per customer and set of values first, so every row is sorted once and not
    once per attribute. A customer's sets, however many rows it has, are then counted per (attribute, value), and the best
    value of each attribute is taken. Equivalent to joining ``most_frequent`` of each attribute."""
    sets = rows.groupBy("customer_id", *ATTRIBUTES).agg(F.count(F.lit(1)).alias("n"), F.max(_when()).alias("latest"))
    values = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in ATTRIBUTES]
    tall = sets.repartition("customer_id").select("customer_id", "n", "latest", F.inline(F.array(*values)))
    unknown = [F.lit(m) for m in ATTRIBUTES.values() if m is not None]
    # Customers without any value keep a row: unknown values are counted as NULL and never picked.
    value = F.when(~F.col("value").isin(*unknown), F.col("value"))
    per_value = tall.groupBy("customer_id", "attribute", value.alias("value")).agg(
        F.sum("n").alias("n"), F.max("latest").alias("latest"))
    picks = []
    for a in ATTRIBUTES:
        mine = (F.col("attribute") == a) & F.col("value").isNotNull()
        best = F.max(F.when(mine, F.struct("n", "latest", "value")))
        picks += [best["value"].alias(a), F.count_if(mine).alias(f"{a}_values")]
    return per_value.groupBy("customer_id").agg(*picks)


def dim_customer(store: Store, rows: DataFrame, locations: Saved, p: Params) -> Saved:
    c = F.col
    one = resolved_attributes(rows).select(
        "customer_id", c("dob").cast("date").alias("dob"), F.coalesce("gender", F.lit("Unknown")).alias("gender"),
        F.coalesce("clean_city", F.lit("UNKNOWN")).alias("clean_city"),
        *[(c(f"{a}_values") > 1).alias(name) for a, name in
          (("dob", "dob_conflict"), ("gender", "gender_conflict"), ("clean_city", "location_conflict"))])
    age = S.age_at(c("dob"), p.as_of)
    known = F.coalesce(age.between(p.min_age, p.max_age), F.lit(False))
    odd = c("dob").isNotNull() & ~known
    conflict = c("dob_conflict") | c("gender_conflict") | c("location_conflict")
    tags = [(c("dob").isNull(), "DOB_MISSING"), (odd, "AGE_OUT_OF_RANGE"), (c("gender") == "Unknown", "GENDER_UNKNOWN"),
            (c("clean_city") == "UNKNOWN", "LOCATION_UNKNOWN"), (conflict, "ATTRIBUTE_CONFLICT")]
    flags = F.concat_ws(",", *[F.when(hit, F.lit(tag)) for hit, tag in tags])
    shaped = one.select(
        "customer_id", "dob", F.when(known, age).alias("age"),
        S.age_group(F.when(known, age)).alias("age_group"),
        F.when(c("dob").isNotNull(), known).alias("age_known"), odd.alias("age_out_of_range"), "gender", "clean_city",
        "dob_conflict", "gender_conflict", "location_conflict", F.nullif(flags, F.lit("")).alias("dq_flag"))
    # A resolved city always comes from the rows, so it is in dim_location unless it is UNKNOWN and no row is.
    # ``txns`` bounds the customers of a city from above, so it still finds every hot city.
    places = locations.of(locations.df.select("clean_city", "location_key", "city_tier", "txns"))
    joined = lookup_join(shaped, places, ["clean_city"], "txns", c("customer_id"))
    return store.save_by("customer_id", "dim_customer", joined.where(c("location_key").isNotNull()))


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key value, and NULL keys."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
                     F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("nulls"))


def orphan_count(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent. Child keys are counted first, so a hot key joins as one row."""
    sizes = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(parent, key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
