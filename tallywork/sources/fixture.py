"""A staging log derived from the order tables, with every kind of dirt a raw log has.

The log keeps the shape of a real one: missing and repeated ids, bad dates and times, placeholder births, misspelt
cities, blank or negative amounts, and copies under new ids.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params

PARAMS = Params(
    window_start=date(1995, 5, 1), window_end=date(2000, 12, 31), extract_end=date(2001, 5, 31),
    trend_split=date(1998, 3, 1), active_days=120, dormant_days=480, newly_observed_days=720, txn_year_pivot=50,
    tier_1_metros=tuple(f"NATION {k}" for k in range(6)), metro_satellites=tuple(f"NATION {k}" for k in range(6, 10)),
    expected_rows=None, min_city_customers=20, top_cities=10, loan_recency_days=240, overlap_top=100)
COPY_EVERY, COPY_AT = 211, 7
VARIANTS = tuple((f"NATON {k}", f"NATION {k}") for k in range(25))


def expected_rows(spark: SparkSession, sf_dir: str) -> int:
    """How many rows the log must have: one per order, and one more per copied order."""
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").agg(
        F.count(F.lit(1)) + F.count_if(key % COPY_EVERY == COPY_AT)).first()[0]


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer x nation as text rows. Both lookups are key joins that Spark sizes itself."""
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    key, cust, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_name")
    text = lambda x: x.cast("string")
    slash = F.lit("/")
    day = F.col("o_orderdate")
    born = F.concat(text(1 + (cust + key % 3) % 28), slash, text(1 + cust % 12), slash,
                    F.lpad(text((30 + (cust * 7) % 71) % 100), 2, "0"))
    base = rows.select(
        key.alias("src_row"),
        F.when(key % 997 == 13, "").when(key % 499 == 17, F.concat(F.lit("T"), text(key - 1)))
        .otherwise(F.concat(F.lit("T"), text(key))).alias("transaction_id"),
        F.concat(F.when(key % 601 == 19, "X").otherwise("C"), text(cust)).alias("customer_id"),
        F.when(cust % 17 == 0, "1/1/1800").when(key % 59 == 1, "nan").otherwise(born).alias("customer_dob"),
        F.when(key % 401 == 0, "").when(key % 1009 == 5, "T")
        .when((cust + (key % 5 == 4).cast("int")) % 2 == 0, "F").otherwise("m ").alias("cust_gender"),
        F.when(key % 701 == 3, " .").when(key % 7 == 0, F.lower(nation))
        .when(key % 11 == 0, F.replace(nation, F.lit("NATION"), F.lit("NATON")))
        .when(key % 9 == 2, F.concat(F.lit("NATION_"), text((F.col("c_nationkey") + 1) % 25)))
        .when(key % 13 == 0, F.concat(F.lit(" "), F.replace(nation, F.lit("_"), F.lit(" - "))))
        .otherwise(nation).alias("cust_location"),
        F.when(key % 311 == 8, "").when(key % 127 == 6, "0.5")
        .otherwise(text((F.col("c_acctbal") + key % 1000).cast("decimal(18,2)"))).alias("cust_account_balance"),
        F.when(key % 503 == 9, "31/2/98")
        .otherwise(F.concat(text(F.dayofmonth(day)), slash, text(F.month(day)), slash,
                            F.substring(text(F.year(day)), 3, 2))).alias("transaction_date"),
        F.when(key % 809 == 11, "250000")
        .otherwise(text(((key * 7919) % 24) * 10000 + ((key * 31) % 60) * 100 + (key * 17) % 60))
        .alias("transaction_time"),
        F.when(key % 331 == 3, "0").when(key % 337 == 4, "-5").when(key % 347 == 6, "").when(key % 353 == 5, "1.5E3")
        .otherwise(text(F.col("o_totalprice").cast("decimal(18,2)"))).alias("transaction_amount"))
    # Each copied row is emitted beside its original, so the base is read once.
    moved = base.select("*", F.explode(F.when(F.col("src_row") % COPY_EVERY == COPY_AT, F.array(F.lit(0), F.lit(100_000_000)))
                                       .otherwise(F.array(F.lit(0)))).alias("_shift"))
    new_id = F.concat(F.lit("T"), text(F.col("src_row") + F.col("_shift")))
    return moved.select(
        (F.col("src_row") + F.col("_shift")).alias("src_row"),
        F.when(F.col("_shift") > 0, new_id).otherwise(F.col("transaction_id")).alias("transaction_id"),
        *[c for c in base.columns if c not in ("src_row", "transaction_id")])
