"""Ranked lexical search of many queries at once, sharing their common subexpressions.

A document's score for an item is a sum over the item's terms, so terms that several items share need be added up once.
The items are put side by side by their least term hash and cut into blocks of ``ITEMS``. In a block:

* terms that occur in exactly the same items are one shared set (a leaf);
* then, largest first, a set of nodes that two items have in common becomes a node of its own, and takes the place of its
  parts in every item that holds all of them, until no two items share more than one node. No two items are chosen
  twice, so a block of n items has at most n * (n - 1) / 2 such nodes.

The nodes are a query-sharing DAG: a leaf adds up its terms' postings, an inner node its parts, an item its nodes. For
every batch of documents each node's accumulators (one per document) are materialised once and combined along the DAG.

The documents are read once: a pass writes the length of every document and the postings of the items' terms, cut by
documents. Document frequencies and lengths are summed over them; then the DAGs are run over the written postings. Every task
keeps the best ``k`` of each item and the few candidates are ranked by Spark. Blocks go to the tasks in batches of at
most ``BATCH_TERMS`` terms, which bounds what is broadcast (a single longer block is a batch alone); each batch is
a pass.

Defined cases: NULL or empty texts have no terms; items without terms and documents without terms rank nowhere. Equal
scores rank by ascending id, NULL ids last. Rows with one id are documents, or items, of their own. Empty tables give an empty
result. A text of any length is taken whole. Other columns are not read, whatever their names. Ids may be of any type
that Arrow holds.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ranks import row_numbers
from ..sources.store import Store
from .packing import pack, record_batch, starts_of, text_blocks, unpack

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
K, ITEMS = 10, 64
BATCH_TERMS = 1 << 19
CELLS = 4 << 20  # accumulators held at once

DAG = pa.schema([("block", pa.int64()), ("terms", pa.list_(pa.string())), ("leaf", pa.binary()), ("leaves", pa.int64()),
                 ("node_sizes", pa.binary()), ("node_parts", pa.binary()), ("items", pa.list_(pa.int64())),
                 ("item_sizes", pa.binary()), ("item_parts", pa.binary())])
DAG_ROW = ("block bigint, terms array<string>, leaf binary, leaves bigint, node_sizes binary, node_parts binary, "
           "items array<bigint>, item_sizes binary, item_parts binary")


def item_terms(items: DataFrame) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(items["text"], UPPER, LOWER), F.lit(TERM), F.lit(0)))


def shared_sets(signature: np.ndarray, count: int) -> tuple[np.ndarray, int, list[np.ndarray], list[np.ndarray]]:
    """The DAG of ``count`` items whose terms have these bit sets of items: (leaf of each term, leaves, parts of each inner
    node, nodes of each item). Inner nodes are numbered after the leaves, parts before their node."""
    sets, leaf = np.unique(signature, return_inverse=True)
    leaves = len(sets)
    holds = np.zeros((count, leaves + count * (count - 1) // 2), np.float32)
    holds[:, :leaves] = (sets[None, :] >> np.arange(count, dtype=np.uint64)[:, None]) & np.uint64(1)
    common = np.triu(holds @ holds.T, 1)
    nodes: list[np.ndarray] = []
    while count > 1 and common.max() >= 2:
        a, b = divmod(int(common.argmax()), count)
        parts = np.flatnonzero(holds[a] * holds[b])
        users = np.flatnonzero(holds[:, parts].all(axis=1))
        holds[np.ix_(users, parts)] = 0
        holds[users, leaves + len(nodes)] = 1
        nodes.append(parts)
        fresh = holds[users] @ holds.T
        common[users, :] = fresh
        common[:, users] = fresh.T
        common = np.triu(common, 1)
    return leaf, leaves, nodes, [np.flatnonzero(row) for row in holds]


def _mined(group: pa.Table) -> pa.Table:
    keys, lists = group.column("item").to_pylist(), group.column("terms").to_pylist()
    number: dict[str, int] = {}
    places = [[number.setdefault(t, len(number)) for t in terms] for terms in lists]
    signature = np.zeros(len(number), np.uint64)
    for at, mine in enumerate(places):
        signature[mine] |= np.uint64(1 << at)
    leaf, leaves, nodes, parts = shared_sets(signature, len(keys))
    joined = lambda lists_: np.concatenate([np.zeros(0, np.int64), *lists_])
    sizes = lambda lists_: np.array([len(x) for x in lists_], np.int64)
    row = [group.column("block")[0].as_py(), list(number), pack(leaf, np.int64), leaves, pack(sizes(nodes), np.int64),
           pack(joined(nodes), np.int64), keys, pack(sizes(parts), np.int64), pack(joined(parts), np.int64)]
    return pa.Table.from_batches([record_batch(DAG, [[v] for v in row])])


def sharing_dags(store: Store, items: DataFrame) -> DataFrame:
    """One row per block of items (item, terms); mined where the block is."""
    saved = store.save("search_items", items)
    order = [F.array_min(F.transform("terms", lambda t: F.xxhash64(t))), F.col("item")]
    ordered = row_numbers(store, "search_order", saved, order, "no")
    blocks = ordered.select(F.floor((F.col("no") - 1) / ITEMS).alias("block"), "item", "terms")
    return store.save("sharing_dags", blocks.groupBy("block").applyInArrow(_mined, DAG_ROW)).df


class Plan:
    """A block's DAG over numbered terms."""

    def __init__(self, row, number: dict[str, int]):
        ids = np.array([number[t] for t in row.terms], np.int64)
        order = np.argsort(ids)
        self.ids, self.leaf, self.leaves = ids[order], unpack(bytes(row.leaf), np.int64)[order], row.leaves
        cut = lambda sizes, parts: np.split(unpack(bytes(parts), np.int64), np.cumsum(unpack(bytes(sizes), np.int64))[:-1])
        self.nodes = cut(row.node_sizes, row.node_parts) if len(unpack(bytes(row.node_sizes), np.int64)) else []
        self.items, self.parts = list(row.items), cut(row.item_sizes, row.item_parts)

    @property
    def width(self) -> int:
        return self.leaves + len(self.nodes)

    def scores(self, docs: np.ndarray, terms: np.ndarray, worth: np.ndarray, count: int) -> np.ndarray:
        """(item, document) scores from postings (document, term, contribution)."""
        at = np.minimum(np.searchsorted(self.ids, terms), len(self.ids) - 1)
        mine = self.ids[at] == terms
        sums = np.zeros((self.width, count), np.int64)
        np.add.at(sums.reshape(-1), self.leaf[at[mine]] * count + docs[mine], worth[mine])
        for no, parts in enumerate(self.nodes, self.leaves):
            sums[no] = sums[parts].sum(0)
        return np.stack([sums[parts].sum(0) for parts in self.parts])


def _postings(terms: list[str], kind: pa.DataType):
    """One row per block of documents: ids, term counts, and the postings of ``terms``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): at for at, t in enumerate(terms)}
        for rows, texts in text_blocks(batches, "text"):
            lengths, sizes, ids, counts = [], [], [], []
            for data in texts:
                words = data.translate(FOLD).split()
                found = Counter(map(number.get, words))
                found.pop(None, None)
                lengths.append(len(words))
                sizes.append(len(found))
                ids += found.keys()
                counts += found.values()
            keys = pa.array([[r[0] for r in rows]], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()),
                 *[pa.array([pack(v, d)]) for v, d in ((lengths, np.int64), (sizes, np.int32), (ids, np.int32),
                                                       (counts, np.int32))]],
                ["ids", "n_docs", "n_terms", "lengths", "sizes", "terms", "counts"])
    return run


def _frequencies(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(count, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                seen += np.bincount(unpack(packed.as_py(), np.int32), minlength=count)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["term", "df"])
    return run


class Best:
    """The best ``k`` (score, id) of each item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        held = self.rows.get(item, [])
        least = -held[-1][0] if len(held) == self.k else 1
        if len(scores) > self.k:
            least = max(least, int(np.partition(scores, -self.k)[-self.k]))
        new = [(-int(scores[at]), ids[at] is None, ids[at]) for at in np.flatnonzero(scores >= least)]
        if new:
            self.rows[item] = heapq.nsmallest(self.k, held + new, key=lambda r: r if r[2] is not None else (*r[:2], 0))


def _ranked(plans, weights, total: int, length: int, k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, widest = Best(k), max(p.width for p in plans.value)
        step = max(1, min(4096, CELLS // max(1, widest)))
        for batch in batches:
            for ids, *packed in zip(*[batch.column(c) for c in ("ids", "lengths", "sizes", "terms", "counts")]):
                n, sizes, terms, tf = (unpack(p.as_py(), d) for p, d in zip(packed, (np.int64, np.int32, np.int32, np.int32)))
                keys, tf = ids.as_py(), tf.astype(np.int64)
                begin = starts_of(sizes.astype(np.int64))
                m = 10 + 90 * n * total // length
                docs = np.repeat(np.arange(len(n)), sizes)
                worth = weights.value[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
                for at in range(0, len(n), step):
                    end = min(at + step, len(n))
                    some = slice(begin[at], begin[end])
                    for plan in plans.value:
                        scores = plan.scores(docs[some] - at, terms[some], worth[some], end - at)
                        for item, row in zip(plan.items, scores):
                            best.add(item, row, keys[at:end])
        rows = [(item, i, -s) for item, found in best.rows.items() for s, _, i in found]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind),
                                          pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])
    return run


def weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("bigint")


def _batches(dags: DataFrame, most: int) -> Iterator[list[int]]:
    """Blocks in batches of at most ``most`` terms, a single larger block alone."""
    held, size = [], 0
    for row in dags.select("block", F.size("terms").alias("n")).orderBy("block").toLocalIterator():
        if held and size + row.n > most:
            yield held
            held, size = [], 0
        held.append(row.block)
        size += row.n
    if held:
        yield held


def best_documents(docs: DataFrame, items: DataFrame, k: int = K, store: Store | None = None,
                   batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    store = store or Store(spark)
    named = items.select("item_id", item_terms(items).alias("terms"), F.monotonically_increasing_id().alias("item")).where(
        F.size("terms") > 0)
    named = store.save("named_items", named).df
    dags = sharing_dags(store, named.select("item", "terms"))
    id_field = docs.schema["doc_id"]
    kind = to_arrow_type(id_field.dataType)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = named.select(F.col("item"), F.lit(None).cast(id_field.dataType).alias("doc_id"),
                       F.lit(None).cast("bigint").alias("score")).limit(0)
    for blocks in _batches(dags, batch_terms):
        rows = dags.where(F.col("block").between(blocks[0], blocks[-1])).collect()
        terms = sorted({t for r in rows for t in r.terms})
        held = T.StructType([T.StructField("ids", T.ArrayType(id_field.dataType)),
                             *[T.StructField(c, T.LongType()) for c in ("n_docs", "n_terms")],
                             *[T.StructField(c, T.BinaryType()) for c in ("lengths", "sizes", "terms", "counts")]])
        index = store.save("postings", texts.mapInArrow(_postings(terms, kind), held)).df
        total, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not total:
            continue
        counted = index.select("terms").mapInArrow(_frequencies(len(terms)), "term bigint, df bigint")
        weighed = counted.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight(F.lit(total), F.col("df")).alias("w"))
        weights = np.zeros(len(terms), np.int64)
        for row in weighed.collect():
            weights[row.term] = row.w
        number = {t: at for at, t in enumerate(terms)}
        plans = spark.sparkContext.broadcast([Plan(r, number) for r in rows])
        sent = spark.sparkContext.broadcast(weights)
        found = index.mapInArrow(_ranked(plans, sent, total, length, k, kind),
                                 T.StructType([T.StructField("item", T.LongType()), id_field, T.StructField("score", T.LongType())]))
        out = out.unionByName(store.save("best", found).df)
        plans.destroy()
        sent.destroy()
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
