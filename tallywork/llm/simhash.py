"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set if over half of the text's shingle hashes have it. Equal fingerprints are collapsed first,
so a group of exact copies is one node. The distance of every node to ``PIVOTS`` reference fingerprints is computed once
and stored with it. For two nodes at ``LINK`` or fewer bits, no coordinate of the two tables differs by more
(triangle inequality).

Which pairs meet at all: the 64 bits are cut into ``b`` blocks; nodes at 3 bits or fewer agree in at least b - 3 blocks,
so they share a bucket for one choice of b - 3 blocks. b grows with the number of nodes, so that a bucket stays small.
In a bucket the nodes are sorted by their first coordinate and compared along it; pairs are discarded by their largest
coordinate difference, and the survivors are verified on the fingerprints. A bucket over ``BUCKET_ROWS`` nodes is cut
into chunks that meet in pairs, each pair a group of its own, so no task holds more than two chunks. Nodes that are
already connected in the bucket are not compared again, and a bucket gives at most one link per node: components stay
whole, and no task emits all pairs of a group.

Defined cases: a NULL or empty text has fingerprint 0 and links like any other. A NULL id takes no part in the smallest
id; a component of NULL ids only has a NULL id. Repeated rows have one fingerprint. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Store
from .components import components
from .packing import starts_of

SHINGLE, SEED, LINK = 3, 42, 3
PIVOTS = 16
BUCKET_ROWS = 8192
HASHES_AT_ONCE = 1 << 16


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the hashes of the numbers from 0 on, as signed longs."""
    return [int(np.array(xxhash.xxh64_intdigest(str(i).encode(), SEED), np.uint64).view(np.int64)) for i in range(count)]


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as a signed long."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    begin = (starts_of(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words) + 1)).tolist()
    size = min(size, len(words))
    ends = (e - 1 for e in begin[size:])
    hashes = np.fromiter((xxhash.xxh64_intdigest(flat[s:e], SEED) for s, e in zip(begin, ends)), np.uint64,
                         len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        some = hashes[at:at + HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (v.as_buffer().to_pybytes() if v.is_valid else None for v in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fingerprint, values), pa.int64())],
                                             ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def distance_table(fp: Column) -> list[Column]:
    """The distances to the pivots, eight to a long, one byte each."""
    near = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint") for p in pivots()]
    packed = []
    for at in range(0, len(near), 8):
        word = near[at]
        for place, distance in enumerate(near[at + 1:at + 8], 1):
            word = word.bitwiseOR(F.shiftleft(distance, 8 * place))
        packed.append(word.alias(f"d{at // 8}"))
    return packed


def block_count(nodes: int, link: int = LINK) -> int:
    """The fewest blocks, from link + 2 on, for which a bucket key has as many values as there are nodes. Texts of one
    language share many bits, so keys of a single block would be far from even."""
    blocks = link + 2
    while blocks < 16 and 2 ** (64 * (blocks - link) // blocks) < nodes:
        blocks += 1
    return blocks


def bucket_keys(fp: Column, blocks: int, link: int = LINK) -> Column:
    """One (choice, key) for each choice of blocks - link blocks: those bits of the fingerprint, the others zero."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [signed(sum(c)) for c in combinations(masks, blocks - link)]
    return F.array(*[F.struct(F.lit(no).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("key"))
                     for no, m in enumerate(choices)])


def links_within(group: np.ndarray, fp: np.ndarray, table: np.ndarray, link: int = LINK) -> np.ndarray:
    """For rows sorted by group, the row each one is connected to: the first of its component in its group."""
    n = len(group)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order].astype(np.int16)
    root = np.arange(n)
    left, step = np.arange(n - 1), 1
    while len(left):
        left = left[left + step < n]
        right = left + step
        near = (group[left] == group[right]) & (table[right, 0] - table[left, 0] <= link)
        left, right = left[near], right[near]
        apart = root[left] != root[right]
        a, b = left[apart], right[apart]
        for pivot in range(1, table.shape[1]):
            if not len(a):
                break
            ok = np.abs(table[a, pivot] - table[b, pivot]) <= link
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= link
        a, b = a[ok], b[ok]
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        step += 1
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group that a batch cuts off is held back for the next one."""
    held: list[np.ndarray] | None = None

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        *keys, fp, d0, d1 = columns
        new = np.zeros(len(fp), bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        table = np.stack([d0, d1], 1).astype("<i8").view(np.uint8).reshape(len(fp), -1)
        root = links_within(np.cumsum(new), fp.view(np.uint64), table)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        last = np.ones(len(columns[0]), bool)
        for key in columns[:3]:
            last &= key == key[-1] if len(key) else True
        cut = int(np.argmax(last)) if len(last) else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield links([c[:cut] for c in columns])
    if held is not None and len(held[0]):
        yield links(held)


def links(store: Store, nodes: DataFrame, count: int, link: int = LINK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between different fingerprints that connect everything within ``link`` bits."""
    keyed = nodes.select("fp", "d0", "d1", F.inline(bucket_keys(F.col("fp"), block_count(count, link), link)))
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("choice", "key"))).where("n > 1")
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    met = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    rows = sized.select("choice", "key", F.explode(met).alias("pair"), "fp", "d0", "d1")
    dealt = rows.repartition("choice", "key", "pair").sortWithinPartitions("choice", "key", "pair")
    return dealt.mapInArrow(_linked, "a bigint, b bigint")


def component_ids(store: Store, ids: DataFrame, parts: DataFrame) -> DataFrame:
    """(fp, component_id) of all nodes (fp, least_id), given the components of the linked ones."""
    linked = ids.join(parts, ids["fp"] == parts["node"]).select("fp", "component", "least_id")
    lowest = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(lowest, "component").select("fp", "component_id")
    alone = ids.join(parts, ids["fp"] == parts["node"], "left_anti").select("fp", F.col("least_id").alias("component_id"))
    return store.save("component_names", named.unionByName(alone)).df


def near_duplicates(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest id it is connected to."""
    store = store or Store(docs.sparkSession)
    prints = store.save("fingerprints", fingerprints(docs)).df
    nodes = store.save("nodes", prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
                       .select("fp", "least_id", *distance_table(F.col("fp"))))
    parts = store.save("components", components(store, links(store, nodes.df.select("fp", "d0", "d1"), nodes.rows))).df
    names = component_ids(store, nodes.df.select("fp", "least_id"), parts)
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """The documents that stay, with their own columns: of each group the row with the smallest id, of rows with one id the
    one with the smallest text hash, of equal rows (id and text) one. NULL ids come last.
    Rows are known by id and text, so a text is judged apart from others that share its id. The rows to drop are written
    first, so Spark knows their size when it plans the joins."""
    store = store or Store(docs.sparkSession)
    names = [f"c{at}" for at in range(len(docs.columns))]
    own, by_name = docs.toDF(*names), dict(zip(docs.columns, names))
    doc_id, text = F.col(by_name["doc_id"]), F.col(by_name["text"])
    key = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.xxhash64(text).alias("hash"))
    found = store.save("near_duplicates", near_duplicates(own.select(key.alias("doc_id"), text.alias("text")), store)).df
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    row = [F.col("doc_id.id").alias("_id"), F.col("doc_id.hash").alias("_hash")]
    drop = store.save("copies", found.where(~stays).select(*row).distinct()).df
    twice = store.save("repeated_rows", found.where(stays).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                       .select(*row)).df

    def same(table: DataFrame) -> Column:
        return (F.col("_row_hash") == table["_hash"]) & doc_id.eqNullSafe(table["_id"])

    left = own.withColumn("_row_hash", F.xxhash64(text)).join(drop, same(drop), "left_anti")
    once = left.join(twice, same(twice), "left_anti")
    one_of = left.join(twice, same(twice), "left_semi").dropDuplicates([by_name["doc_id"], "_row_hash"])
    return once.unionByName(one_of).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
