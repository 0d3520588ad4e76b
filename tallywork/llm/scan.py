"""Running values along segments of a sorted table, without one task holding a segment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store

PART_SHIFT = 33  # monotonically_increasing_id: the partition above, the place in it below


def running(store: Store, name: str, df: DataFrame, segment: str, order: list[Column], values: dict[str, str],
            total: Callable[[str], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``values`` (new column -> column): the running ``total`` (an aggregate of a column) within each segment (a
    column that is not NULL), in ``order``; ``join`` puts two totals together.

    The table is range-sorted and written. Each sort partition runs alone; only the segment that it starts with can have
    begun earlier, so what is carried in is one row per sort partition, which is broadcast."""
    at = F.monotonically_increasing_id()
    placed = store.save(name, df.orderBy(segment, *order).withColumn("_at", at)).df.withColumn(
        "_part", F.shiftright("_at", PART_SHIFT))
    local = Window.partitionBy("_part", segment).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    first = placed.groupBy("_part").agg(F.min(segment).alias(segment))
    pieces = placed.join(F.broadcast(first.select(segment).distinct()), segment).groupBy(segment, "_part").agg(
        *[total(c).alias(f"_{v}") for v, c in values.items()])
    earlier = Window.partitionBy(segment).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(segment, "_part", *[total(f"_{v}").over(earlier).alias(f"_{v}") for v in values])
    ran = placed.select("*", *[total(c).over(local).alias(v) for v, c in values.items()])
    out = ran.join(F.broadcast(carried), ["_part", segment], "left")
    for v in values:
        out = out.withColumn(v, F.when(F.col(f"_{v}").isNull(), F.col(v)).otherwise(join(F.col(v), F.col(f"_{v}"))))
    return out.select(*df.columns, *values)


def running_sum(store: Store, name: str, df: DataFrame, segment: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    return running(store, name, df, segment, order, values, F.sum, lambda a, b: a + b)


def running_xor(store: Store, name: str, df: DataFrame, segment: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    return running(store, name, df, segment, order, values, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
