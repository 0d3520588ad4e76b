"""Joins to a table with one row per key that stay even when one key holds a large part of the rows.

A key is hot when its rows would fill more than half of a mean shuffle partition. At most twice as many keys as shuffle
partitions can be hot, so the hot side is small enough to broadcast whatever the data size; the rest is joined through
a shuffle. Rows of hot keys, and rows whose key is NULL, are spread over a salt there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Saved, Store

SALTS = 1 << 20


def lookup_join(left: DataFrame, right: Saved, on: list[str], weight: str, spread: Column) -> DataFrame:
    """Left join to ``right`` (unique on the keys). ``weight`` is its column with the number of left rows per key;
    ``spread`` is a left column with many values, which scatters the rows of hot keys."""
    carried = [c for c in right.df.columns if c not in on and c != weight]
    total = right.df.agg(F.sum(weight)).scalar()
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(weight) * (2 * partitions) > total
    hot = right.df.where(is_hot).select(*on, F.struct(*carried).alias("_hot"), F.lit(True).alias("_is_hot"))
    cold = right.df.where(~is_hot).select(*on, F.struct(*carried).alias("_cold"),
                                       F.pmod(F.hash(*on), F.lit(1)).alias("_salt"))
    # The cold side's salt is 0, but not as a constant: Spark would drop a constant from the join keys, and the spread
    # with it.
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in on))
    salt = F.when(F.col("_is_hot") | missing, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    joined = (left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt)
              .join(cold, [*on, "_salt"], "left"))
    picked = [F.when(F.col("_is_hot"), F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")).alias(c) for c in carried]
    return joined.select(*[F.col(c) for c in left.columns], *picked)


def repeated_keys(store: Store, name: str, df: DataFrame, keys: dict[str, Column],
                  extra: dict[str, Column] | None = None) -> Saved:
    """Keys that occur more than once, with their count ``n`` and further aggregates. Counted map-side first, so a
    hot key crosses the shuffle once per task."""
    aggregates = [F.count(F.lit(1)).alias("n")] + [c.alias(k) for k, c in (extra or {}).items()]
    return store.save(name, df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*aggregates).where("n > 1"))
