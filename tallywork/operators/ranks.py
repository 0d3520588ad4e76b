"""Global ranks and exact quantiles without a single-partition window.

Values are first counted, so ties collapse before any shuffle by value. The distinct values are range-sorted, written with their place (partition number and row within it), and turned into positions by adding one
prefix sum over the partitions. Every rank function and every exact quantile follows from the first and last position of a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed, pair_columns
from ..sources.store import Saved, Store
from .skew import lookup_join

_PART_SHIFT = 33
_IN_PART = (1 << _PART_SHIFT) - 1


def _placed(store: Store, name: str, df: DataFrame, order: list[Column]) -> DataFrame:
    """Globally sorted and written, with ``_part`` (range partition) and ``_place`` (row within it, from 0). The ranges are as
    many as a shuffle has partitions, also where their rows are few bytes: Spark would join those into one task."""
    at, ranges = F.monotonically_increasing_id(), int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    saved = store.save(name, dealt.withColumn("_at", at)).df
    return (saved.withColumn("_part", F.shiftright("_at", _PART_SHIFT))
            .withColumn("_place", F.col("_at").bitwiseAND(F.lit(_IN_PART))))


def _with_offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """Adds ``_before``: the weight in all earlier partitions. One row per sort partition is windowed and broadcast."""
    parts = placed.groupBy("_part").agg(F.sum(weight).alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(parts), "_part")


def row_numbers(store: Store, name: str, table: Saved, order: list[Column], column: str) -> DataFrame:
    """Global row_number for an order that is unique per row (include an id), by a distributed sort."""
    numbered = _with_offsets(_placed(store, name, table.df, order), F.lit(1))
    return numbered.withColumn(column, F.col("_before") + F.col("_place") + 1).drop("_before", "_part", "_place", "_at")


def distribution(store: Store, name: str, df: DataFrame, measures: list[str], by: list[str] | None = None,
                 counts: dict[str, Column] | None = None, weight: Column | None = None, keep: bool = False) -> Saved:
    """One row per (measure, group, value): ``n`` copies at positions ``first``..``last`` of ``total``.

    ``measures`` are numeric columns of ``df`` (NULLs are left out). ``by`` splits into groups (non-null columns),
    each ranked alone.
    ``counts`` adds conditional counts per value; their conditions may read any column of ``df``. ``weight`` is the
    number of copies a row stands for. ``keep`` writes the result, for a distribution that is read many times.
    """
    by, counts = by or [], counts or {}
    keys = ["measure", *by]
    flags = [c.alias(k) for k, c in counts.items()]
    tall = df.select(*by, *flags, (weight if weight is not None else F.lit(1)).alias("_copies"),
                     F.inline(pair_columns(measures))).where(F.col("value").isNotNull())
    tallied = store.save(f"{name}_counts", tall.groupBy(*keys, "value").agg(
        F.sum("_copies").alias("n"), *[F.count_if(F.col(k)).alias(k) for k in counts]))
    final = _positions(store, name, tallied, keys, list(counts))
    return store.save(name, final) if keep else tallied.of(final)


def _positions(store: Store, name: str, tallied: Saved, keys: list[str], counts: list[str]) -> DataFrame:
    """A distributed sort, running sums inside each range and offsets between them."""
    order = [F.col(k).asc_nulls_first() for k in (*keys, "value")]
    placed = _placed(store, f"{name}_sorted", tallied.df, order)
    ranges = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    running = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    ended = _with_offsets(placed, F.col("n")).repartition(ranges, "_part").withColumn("_end", F.col("_before") + F.sum("n").over(running))
    totals = ended.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.min(F.col("_end") - F.col("n")).alias("_start"),
        F.count(F.lit(1)).alias("_values"))
    if keys == ["measure"]:  # as many rows as measures were asked for
        ended = ended.join(F.broadcast(totals.drop("_values")), "measure")
    else:
        ended = lookup_join(ended, store.save(f"{name}_groups", totals), keys, "_values", F.col("value"))
    return ended.select(*keys, "value", "n", *counts, (F.col("_end") - F.col("n") - F.col("_start") + 1).alias("first"),
                        (F.col("_end") - F.col("_start")).alias("last"), "total")


def subset_mids(store: Store, name: str, df: DataFrame, measures: list[str], subsets: dict[str, Column]) -> Saved:
    """One row per (measure, value): ``n`` rows, and for each subset of the rows twice the mid-rank that the value has among
    the subset's known values (``mid_`` and its name; ``mid_all`` for all rows). A row is tall once per measure, whatever the
    number of subsets: their positions are running sums over the same sorted values."""
    tall = df.select(*[x.alias(k) for k, x in subsets.items()], F.inline(pair_columns(measures))).where(F.col("value").isNotNull())
    tallied = store.save(f"{name}_counts", tall.groupBy("measure", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(k)).alias(k) for k in subsets]))
    placed = _placed(store, f"{name}_sorted", tallied.df, [F.asc("measure"), F.asc("value")])
    ranges, counted = int(store.spark.conf.get("spark.sql.shuffle.partitions")), {"all": "n", **{k: k for k in subsets}}
    # What comes before a range within its first measure; a measure that starts in the range starts from 0.
    parts = placed.groupBy("_part", "measure").agg(*[F.sum(x).alias(f"_sum_{k}") for k, x in counted.items()])
    earlier = Window.partitionBy("measure").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "measure", *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in counted])
    running = Window.partitionBy("_part", "measure").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.repartition(ranges, "_part").withColumns({f"_run_{k}": F.sum(x).over(running) for k, x in counted.items()})
    mids = [(2 * (F.col(f"_before_{k}") + F.col(f"_run_{k}")) - F.col(x) + 1).alias(f"mid_{k}") for k, x in counted.items()]
    # At most as many rows as ranges and measures.
    final = ended.join(F.broadcast(parts), ["_part", "measure"]).select("measure", "value", "n", *mids)
    return store.save(name, final)


def quantiles(dist: Saved, wanted: dict[str, tuple[str, float]], by: list[str] | None = None) -> DataFrame:
    """Exact continuous quantiles, one row (per group). ``wanted`` maps a column to (measure, p). Only the values at the
    two positions of each quantile pass the filter, so the aggregate sees a handful of rows per group."""
    columns, hits = [], F.lit(False)
    for ask, (measure, p) in wanted.items():
        mine, at = F.col("measure") == measure, (F.col("total") - 1).cast("double") * F.lit(float(p))
        low, high = ((place + 1).between(F.col("first"), F.col("last")) & mine for place in (F.floor(at), F.ceil(at)))
        hits = hits | low | high
        lo, hi = F.max(F.when(low, F.col("value"))), F.max(F.when(high, F.col("value")))
        columns.append((lo + (hi - lo) * F.max(F.when(mine, at - F.floor(at)))).alias(ask))
    return dist.df.where(hits).groupBy(*(by or [])).agg(*columns)


def weighted_summary(store: Store, name: str, df: DataFrame, column: str, copies: str | None, by: list[str],
                     places: int = 2) -> DataFrame:
    """Per group: rows, mean and median of a column whose rows may stand for several copies, from one aggregate over the
    distribution. NULL values are left out."""
    dist = distribution(store, name, df, [column], by=by, weight=F.col(copies) if copies else None)
    at = (F.col("total") - 1).cast("double") * 0.5
    low, high = ((place + 1).between(F.col("first"), F.col("last")) for place in (F.floor(at), F.ceil(at)))
    lo, hi = F.max(F.when(low, F.col("value"))), F.max(F.when(high, F.col("value")))
    worth = F.sum(F.col("value").cast("decimal(38,6)") * F.col("n")).cast("double")
    return dist.df.groupBy(*by).agg(F.sum("n").alias("rows"), fixed(worth / F.sum("n"), places).alias(f"mean_{column}"),
                                    (lo + (hi - lo) * F.max(at - F.floor(at))).alias(f"median_{column}"))


# Rank functions of a value from its positions.
def rank_of() -> Column:
    return F.col("first")


def percent_rank_of() -> Column:
    return F.when(F.col("total") > 1, (F.col("first") - 1) / (F.col("total") - 1)).otherwise(F.lit(0.0))


def cume_dist_of() -> Column:
    return F.col("last") / F.col("total")


def cume_dist_desc_of() -> Column:
    return (F.col("total") - F.col("first") + 1) / F.col("total")


def twice_mid_rank_of() -> Column:
    return F.col("first") + F.col("last")


def positions(df: DataFrame, key: str, measures: list[str], dist: Saved) -> DataFrame:
    """Tall rows (key, measure, value) with the positions of their value; NULL values are left out."""
    tall = df.select(key, F.inline(pair_columns(measures))).where(F.col("value").isNotNull())
    places = dist.of(dist.df.select("measure", "value", "n", "first", "last", "total"))
    return lookup_join(tall, places, ["measure", "value"], "n", F.col(key))


def ranked(df: DataFrame, key: str, measures: list[str], dist: Saved, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per key with rank columns; ``wanted`` maps a column to (measure, function of positions).
    A NULL value has a NULL rank."""
    seen = positions(df, key, measures, dist)
    return seen.groupBy(key).agg(*[F.max(F.when(F.col("measure") == m, c)).alias(k) for k, (m, c) in wanted.items()])


def tile_of(position: Column, total: Column, tiles: int) -> Column:
    """NTILE bucket of a position: the first ``total % tiles`` buckets hold one more."""
    size, extra = F.floor(total / tiles), total % tiles
    wide = extra * (size + 1)
    early = F.floor((position - 1) / (size + 1)) + 1
    late = extra + F.floor((position - wide - 1) / F.greatest(size, F.lit(1))) + 1
    return F.when(position <= wide, early).otherwise(late).cast("int")


def tiles(dist: DataFrame, tiles: int, descending: bool = False) -> DataFrame:
    """Splits the copies of each value over NTILE buckets: (tile, value, copies)."""
    total = F.col("total")
    first = (total - F.col("last") + 1) if descending else F.col("first")
    last = (total - F.col("first") + 1) if descending else F.col("last")
    spread = dist.select("value", "total", first.alias("f"), last.alias("l"))
    spread = spread.select("*", F.explode(F.sequence(tile_of(F.col("f"), total, tiles),
                                                     tile_of(F.col("l"), total, tiles))).alias("tile"))
    size, extra, tile = F.floor(total / tiles), total % tiles, F.col("tile")
    start = (tile - 1) * size + F.least(tile - 1, extra) + 1
    end = tile * size + F.least(tile, extra)
    copies = F.least(F.col("l"), end) - F.greatest(F.col("f"), start) + 1
    return spread.select("tile", "value", copies.cast("bigint").alias("copies"))


def top_count(total: Column, share: float) -> Column:
    """int(n * share), as the size of the top group."""
    return F.floor(total.cast("double") * F.lit(share)).cast("bigint")


def copies_in_top(take: Column) -> Column:
    """How many copies of a value are among the ``take`` largest."""
    above = F.col("total") - F.col("last")
    return F.greatest(F.least(F.col("n"), take - above), F.lit(0))


def top_share(dist: DataFrame, share: float) -> Column:
    """Aggregate: share of the sum held by the largest ``share`` of the values."""
    worth = F.col("value").cast("decimal(38,4)")
    return F.sum(worth * copies_in_top(top_count(F.col("total"), share))).cast("double") / \
        F.sum(worth * F.col("n")).cast("double")
