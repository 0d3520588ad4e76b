"""A ledger of loaded files: one row per file with bytes, rows and an order-free fingerprint. A later load takes only files
that are new or have changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import read_csv, text_bytes, text_fingerprint

LEDGER = ("file_name string, file_bytes bigint, modified timestamp, rows_loaded bigint, text_bytes bigint, malformed_rows bigint, "
          "fingerprint string")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_bytes, modified) of a folder or pattern; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file_name"), F.col("length").alias("file_bytes"),
                        F.col("modificationTime").alias("modified"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The last row of each file; an absent ledger has none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(ledger)
    other = [c for c in rows.columns if c not in ("file_name", "modified")]
    last = rows.groupBy("file_name").agg(F.max(F.struct("modified", *other)).alias("r"))
    return last.select("file_name", "r.*").select(*rows.columns)


def unseen_files(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """Files that the ledger does not hold with the same size and time."""
    return list_files(spark, path).join(read_ledger(spark, ledger).select("file_name", "file_bytes", "modified"),
                                        ["file_name", "file_bytes", "modified"], "left_anti")


def file_rows(staging: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger rows of a landed load; ``src_row`` of ``read_csv`` carries the file. A file without rows has zeros."""
    per = staging.groupBy(F.col("src_row.file_path").alias("file_name")).agg(
        F.count(F.lit(1)).alias("rows_loaded"), F.sum(text_bytes()).alias("text_bytes"),
        F.count_if("malformed").alias("malformed_rows"), text_fingerprint().alias("fingerprint"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return files.join(per, "file_name", "left").select(
        "file_name", "file_bytes", "modified", *map(zero, ("rows_loaded", "text_bytes", "malformed_rows")),
        F.coalesce("fingerprint", F.lit("0")).alias("fingerprint"))


def load_new(spark: SparkSession, path: str, ledger: str, land) -> DataFrame | None:
    """Reads the new and changed files of ``path``, passes their rows to ``land`` (which writes them and returns the written
    table), and records the files. Files are recorded after their rows are landed, so a load that fails is taken again.
    None when there is nothing new. Names of new files pass through the driver, which names them to the reader."""
    files = unseen_files(spark, path, ledger).collect()
    if not files:
        return None
    kept = spark.createDataFrame(files, "file_name string, file_bytes bigint, modified timestamp")
    landed = land(read_csv(spark, [f.file_name for f in files]))
    file_rows(landed, kept).write.mode("append").parquet(ledger)
    return landed

