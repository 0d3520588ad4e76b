"""K-d tree sharding: nodes are split at distributed weighted medians along their widest metadata dimension.

A node that holds n leaves is split so that the left side gets n // 2 of n parts of its bytes. The split point is found
for all nodes of a level at once: sizes are summed over buckets of the node's value range, the bucket with the split
point is summed again over finer buckets, until one coordinate is left. Ties of the dimension are ordered by a hash of
the row, so equal values are split too. Only bucket sums reach the driver: at most ``BUCKETS`` per node and pass. Rows move down
the tree by looking up their node's split, without a join or a sort.

Defined cases: a NULL text has no bytes and checksum 0. NULL metadata sorts before all values. Rows alike in id,
checksum and metadata share a shard. With fewer rows than shards some shards are empty. An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Saved, Store

BUCKETS = 1024
TIE_BITS = 62
ROWS_PER_RUN = 50_000
ROW_BYTES = 16


def with_ranks(store: Store, rows: DataFrame, column: str, rank: str) -> DataFrame:
    """Replaces a text column by ``rank``, the place of its value among the distinct ones in code-point order; NULL is -1.
    The values are sorted and numbered by partition, none passes through the driver."""
    values = store.save("values", rows.select(F.col(column).alias("_value")).where("_value is not null").distinct()).df
    numbered = values.sort("_value").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    ranks = store.save("ranks", store.spark.createDataFrame(numbered, "_value string, _rank bigint")).df
    joined = rows.join(ranks, rows[column] == ranks["_value"], "left")
    return joined.withColumn(rank, F.coalesce("_rank", F.lit(-1).cast("bigint"))).drop(column, "_value", "_rank")


def number_coordinate(value: Column) -> Column:
    return F.coalesce(value.cast("bigint"), F.lit(-1))


@dataclass
class Node:
    """``leaves`` shards from ``first`` on. A split node sends rows up to (``value``, ``tie``) of dimension ``dim`` to
    its ``left`` child and the others to ``right``; a leaf points to itself."""

    leaves: int
    first: int
    left: int
    right: int
    depth: int = 0
    dim: int = 0
    value: int = 0
    tie: int = 0


@dataclass
class _Search:
    """The interval that holds a node's split point, over its dimension, or over the ties once the value is known."""

    dim: int
    low: int
    high: int
    want: float
    below: int = 0
    value: int | None = None

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BUCKETS))


def _of_node(values: list, node: str = "node") -> Column:
    """A constant looked up by node number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(node) + 1)


def moved_down(rows: DataFrame, nodes: list[Node], dims: list[str]) -> DataFrame:
    """``node`` becomes the child that the row belongs to."""
    at = F.element_at(F.array(*[F.col(d) for d in dims]), _of_node([n.dim + 1 for n in nodes]))
    value, tie = _of_node([n.value for n in nodes]).cast("bigint"), _of_node([n.tie for n in nodes]).cast("bigint")
    left = (at < value) | ((at == value) & (F.col("tie") <= tie))
    return rows.withColumn("node", F.when(left, _of_node([n.left for n in nodes])).otherwise(_of_node([n.right for n in nodes])))


def _split(nodes: list[Node], k: int, dim: int, value: int, tie: int) -> None:
    n, half = nodes[k], nodes[k].leaves // 2
    n.dim, n.value, n.tie, n.left, n.right = dim, value, tie, len(nodes), len(nodes) + 1
    nodes.append(Node(half, n.first, n.left, n.left, n.depth + 1))
    nodes.append(Node(n.leaves - half, n.first + half, n.right, n.right, n.depth + 1))


def _split_level(rows: DataFrame, nodes: list[Node], dims: list[str], spread: list[int]) -> bool:
    """Splits every node that holds more than one leaf. False when there is none."""
    wide = [k for k, n in enumerate(nodes) if n.left == k and n.leaves > 1]
    if not wide:
        return False
    here = rows.where(F.col("node").isin(wide))
    bounds = [f(F.col(d)).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]
    seen = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).collect()}
    searches: dict[int, _Search] = {}
    for k in wide:
        if k not in seen:  # no rows: any split will do
            _split(nodes, k, 0, -1, -1)
            continue
        r = seen[k]
        widest = max(range(len(dims)), key=lambda d: (r[f"high_{dims[d]}"] - r[f"low_{dims[d]}"]) / max(1, spread[d]))
        searches[k] = _Search(widest, r[f"low_{dims[widest]}"], r[f"high_{dims[widest]}"],
                              r["bytes"] * (nodes[k].leaves // 2) / nodes[k].leaves)
    upto = max(wide) + 1
    while searches:
        pick = lambda f, other=0: _of_node([f(searches[k]) if k in searches else other for k in range(upto)])
        at = F.element_at(F.array(*[F.col(d) for d in dims]), pick(lambda s: s.dim + 1, 1))
        x = F.when(pick(lambda s: s.value is not None, False), F.when(F.col("_d") == F.col("_v"), F.col("tie"))) \
            .otherwise(F.col("_d"))
        tally = (here.where(F.col("node").isin(list(searches)))
                 .select("node", "size", "tie", at.alias("_d"), pick(lambda s: s.value or 0).cast("bigint").alias("_v"),
                         pick(lambda s: s.low).cast("bigint").alias("_low"), pick(lambda s: s.high).cast("bigint").alias("_high"),
                         pick(lambda s: s.width, 1).cast("bigint").alias("_width"))
                 .select("node", "size", "_low", "_high", "_width", x.alias("x")).where("x between _low and _high")
                 .groupBy("node", F.expr("(x - _low) div _width").alias("bucket"))
                 .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"),
                      F.max("x").alias("high")).collect())
        buckets: dict[int, list] = {k: [] for k in searches}
        for r in sorted(tally, key=lambda r: r["bucket"]):
            buckets[r["node"]].append(r)
        for k, sums in buckets.items():
            s = searches[k]
            for r in sums:
                if s.below + r["bytes"] >= s.want:
                    break
                s.below += r["bytes"]
            if r["low"] < r["high"]:
                s.low, s.high = r["low"], r["high"]
            elif s.value is None and r["rows"] > 1:
                s.value, s.low, s.high = r["low"], 0, (1 << TIE_BITS) - 1
            else:
                whole = abs(s.below + r["bytes"] - s.want) <= abs(s.want - s.below)
                if s.value is None:
                    _split(nodes, k, s.dim, r["low"], (1 << TIE_BITS) if whole else -1)
                else:
                    _split(nodes, k, s.dim, s.value, r["low"] if whole else r["low"] - 1)
                del searches[k]
    return True


def kd_tree(store: Store, rows: Saved, dims: list[str], shards: int) -> tuple[list[Node], Saved]:
    """The tree over written ``rows`` with columns ``size``, ``tie`` and the coordinates ``dims``, and the rows with
    ``node``, the leaf each is in. After each level the narrow rows are written with their new node."""
    nodes = [Node(shards, 0, 0, 0)]
    bounds = [f(F.col(d)).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]
    r = rows.df.agg(*bounds).first()
    rows = rows.of(rows.df.withColumn("node", F.lit(0)))
    if r[0] is not None:
        spread = [r[f"high_{d}"] - r[f"low_{d}"] for d in dims]
        while _split_level(rows.df, nodes, dims, spread):
            rows = store.save("kd_level", moved_down(rows.df, nodes, dims))
    return nodes, rows


def with_slots(store: Store, assigned: Saved, shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard. A shard is numbered in runs of rows with neighbouring hashes, and
    each run starts after the rows of the runs before it; no task holds a whole shard."""
    bits = max(4, ceil(log2(max(1, assigned.rows / (shards * ROWS_PER_RUN)))))
    runs = assigned.df.withColumn("_run", F.shiftright("tie", TIE_BITS - bits))
    counts = runs.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("tie", "doc_id"))
    numbered = runs.withColumn("_place", place).join(offsets, ["shard", "_run"])
    return numbered.withColumn("slot", F.col("_before") + F.col("_place") - 1)


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
                    store: Store | None = None) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 16), text_crc32, shard and slot. Either the number of
    leaves or the bytes of a leaf is given. Dimensions are source, language, length and id."""
    store = store or Store(docs.sparkSession)
    dims = ["by_source", "by_lang", "by_length", "by_id"]
    crc = F.coalesce(F.crc32(F.col("text")), F.lit(0))
    narrow = store.save("shard_narrow", docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        crc.alias("text_crc32"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        number_coordinate(F.col("n_chars")).alias("by_length"), number_coordinate(F.col("doc_id")).alias("by_id"))).df
    narrow = with_ranks(store, with_ranks(store, narrow, "source", "by_source"), "lang", "by_lang")
    mixed = F.xxhash64("doc_id", "text_crc32", *dims)
    rows = store.save("shard_rows", narrow.withColumn("tie", F.shiftrightunsigned(mixed, 64 - TIE_BITS)))
    if shards is None:
        shards = max(1, ceil((rows.df.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    nodes, leaves = kd_tree(store, rows, dims, shards)
    assigned = leaves.of(leaves.df.withColumn("shard", _of_node([n.first for n in nodes])))
    return with_slots(store, assigned, shards).select("doc_id", "size", "text_crc32", "shard", "slot")
