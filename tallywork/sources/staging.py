"""The raw log as all-text rows, plus the small inputs that configure a run."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_COLUMNS = ("transaction_id", "customer_id", "customer_dob", "cust_gender", "cust_location",
               "cust_account_balance", "transaction_date", "transaction_time", "transaction_amount")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
SEGMENTS_FILE = Path(__file__).with_name("segments.json")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-text CSV with header, no row lost; an empty field is NULL. ``src_row`` orders rows by file and place;
    ``malformed`` marks lines with too few or too many fields."""
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(path).withColumn("_place", F.monotonically_increasing_id()))
    # Input splits of one file are read as partitions by size, not by place; the block start restores file order.
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_place"))
    return raw.select(place.alias("src_row"), *RAW_COLUMNS, F.col("_bad").isNotNull().alias("malformed"))


def text_bytes() -> Column:
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in RAW_COLUMNS), F.lit(0))


def text_fingerprint() -> Column:
    """Aggregate: equal for equal rows in any order."""
    line = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\u0000")) for c in RAW_COLUMNS]).cast("decimal(38,0)")
    return F.sum(line).cast("string")


def load_audit(staging: DataFrame) -> DataFrame:
    """Rows, bytes of text and an order-free fingerprint of a load."""
    bad = F.count_if("malformed") if "malformed" in staging.columns else F.lit(0).cast("bigint")
    return staging.agg(F.count(F.lit(1)).alias("rows_loaded"), F.sum(text_bytes()).alias("text_bytes"), bad.alias("malformed_rows"),
                       text_fingerprint().alias("fingerprint"))


def file_audit(staging: DataFrame) -> DataFrame:
    """Rows per source file; ``src_row`` of ``read_csv`` carries the path."""
    return staging.groupBy(F.col("src_row.file_path").alias("file_name")).agg(F.count(F.lit(1)).alias("rows_loaded"))


def variants_table(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame(list(pairs), "variant string, clean_city string")


def segment_config(path: str | Path = SEGMENTS_FILE) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def segment_definitions(spark: SparkSession, config: dict) -> DataFrame:
    """One row per segment. The descriptive texts are the caller's; a configuration may leave them out."""
    columns = ("cluster_key", "segment_id", "segment_name", "potential_needs", "action", "owner", "timing", "kpi",
               "expect")
    rows = [tuple(s.get(c) for c in columns) for s in config["segments"]]
    schema = ", ".join(f"{c} {'int' if c == 'segment_id' else 'string'}" for c in columns)
    return spark.createDataFrame(rows, schema)
