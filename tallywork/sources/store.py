"""Written tables on shared storage: the cut points between stages."""

from __future__ import annotations

import atexit
import re
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Saved:
    """A written table with its row count."""

    df: DataFrame
    rows: int

    def of(self, df: DataFrame) -> "Saved":
        """The same row count for a projection of the table."""
        return replace(self, df=df)


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session may do without it and takes its warehouse; on a
    cluster that folder could be the driver's own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir")


def spread(df: DataFrame) -> DataFrame:
    """A log that arrives in fewer splits than cores (one small or unsplittable file) is dealt out once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def replace_folder(spark: SparkSession, made: str, path: str) -> None:
    """Puts the written folder ``made`` in the place of ``path`` by renames. The old folder goes last, and comes back when the
    new one cannot take its place."""
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = new_path(path), new_path(made), new_path(f"{path}.old-{uuid.uuid4().hex[:8]}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot put {made} in the place of {path}")
    if had:
        fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Store:
    """Writes each stage once as parquet and reads it back, so a lost executor only re-reads files."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        run = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        self.root = f"{(root or shared_root(spark)).rstrip('/')}/tallywork/{run}"
        self._saves, self._tables = 0, []
        atexit.register(self.close)  # frames over the stages end with the session

    def path(self, name: str) -> str:
        """A new folder of this run for tables that are not stages."""
        self._saves += 1
        return f"{self.root}/{self._saves:04d}_{re.sub(r'[^A-Za-z0-9_]', '_', name)}"

    def save(self, name: str, df: DataFrame) -> Saved:
        # A name saved again gets a new path: frames read from the first one stay valid.
        path = self.path(name)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        # A stated schema spares the footer-reading job.
        rows = seen.get["rows"]
        return Saved(self.spark.read.schema(df.schema).parquet(path), rows)

    def save_by(self, key: str, name: str, df: DataFrame) -> Saved:
        """Like ``save``, in hash buckets of the key, as many as a shuffle has partitions. Joins and aggregates by the key
        take the buckets as they lie, so only the write moves rows, and not even it where they are dealt by the key
        already. For tables with few rows per key."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table, seen = f"tallywork_{uuid.uuid4().hex}", Observation()
        dealt = df.repartition(buckets, key).observe(seen, F.count(F.lit(1)).alias("rows"))
        self._tables.append(table)
        dealt.write.format("parquet").bucketBy(buckets, key).option("path", self.path(name)).saveAsTable(table)
        return Saved(self.spark.table(table), seen.get["rows"])

    def close(self) -> None:
        """Removes the stages of this run; frames read from them are no longer valid. A stopped session leaves them."""
        if self.spark.sparkContext._jsc is None:
            return
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
        remove_folder(self.spark, self.root)
