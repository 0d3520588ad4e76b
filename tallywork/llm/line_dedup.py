"""Line dedup over a sharded minimal perfect hash.

One scan cuts the documents into blocks and takes the distinct line keys of each. A block sends every key once to the
shard of its hash, with the number of the block's documents and their largest id, so a line that is in every document
crosses the shuffle once per block. A shard sums the distinct hashes, builds a minimal perfect hash over them and lays
fingerprints and counts out in its order; ids of the keeping document are stored for the frequent lines alone. Blocks
then probe the shards with packed hashes, and get back the numbers of the lines to drop: no join on lines.

Defined cases: a NULL or empty text is one empty line and stays. Each row is a document; rows with the id of the keeping
document all keep the line, so repeated rows are treated alike. A NULL id is smaller than all others. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from .packing import pack, pack_text, record_batch, starts_of, text_blocks, unpack, unpack_text
from .perfect_hash import build, places

SPACE = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
NO_ID = -(1 << 63)
BLOCKS_A_TASK = 1 << 24

LINES = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("numbers", pa.binary()), ("hashes", pa.binary()),
                   ("prints", pa.binary()), ("docs", pa.binary()), ("tops", pa.binary()), ("ids", pa.binary()),
                   ("sizes", pa.binary()), ("texts", pa.binary())])
LINES_DDL = ("block bigint, shard int, numbers binary, hashes binary, prints binary, docs binary, tops binary, "
             "ids binary, sizes binary, texts binary")
INDEX = pa.schema([("shard", pa.int32()), ("keys", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()),
                   ("prints", pa.binary()), ("docs", pa.binary()), ("often", pa.binary()), ("keepers", pa.binary()),
                   ("rest", pa.binary())])
INDEX_DDL = ("shard int, keys bigint, sizes binary, bits binary, prints binary, docs binary, often binary, "
             "keepers binary, rest binary")


def line_keys(text: bytes, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """The key of each line; None for a key that is too short to count."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        long = len(key) >= 4 * least_chars or len(key) >= least_chars and len(key.decode("utf-8", "replace")) >= least_chars
        keys.append(key if long else None)
    return keys


def numbered(texts: list[bytes], least_chars: int) -> tuple[dict[bytes, int], list[list[int]]]:
    """The block's keys in order of appearance, and for each text the number of each line's key, or -1."""
    known: dict[bytes, int] = {}
    return known, [[-1 if k is None else known.setdefault(k, len(known)) for k in line_keys(t, least_chars)] for t in texts]


def _scan(shards: int, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * BLOCKS_A_TASK
        for rows, texts in text_blocks(batches, "text"):
            ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)
            known, lines = numbered(texts, least_chars)
            distinct = [np.unique(np.array([k for k in doc if k >= 0], np.int64)) for doc in lines]
            number = np.concatenate(distinct)
            docs = np.bincount(number, minlength=len(known))
            tops = np.full(len(known), NO_ID)
            np.maximum.at(tops, number, np.repeat(ids, [len(d) for d in distinct]))
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), "<u8").reshape(-1, 2)
            shard = (both[:, 0] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = starts_of(np.bincount(shard, minlength=shards))
            out = []
            for s in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[s]:cut[s + 1]]
                out.append((block, s, pack(own, np.uint32), pack(both[own, 0], np.uint64), pack(both[own, 1], np.uint64),
                            pack(docs[own], np.uint32), pack(tops[own], np.int64), None, None, None))
            out.append((block, -1, None, None, None, None, None, pack(ids, np.int64),
                        pack([len(t) for t in texts], np.int64), pack_text(b"".join(texts))))
            yield record_batch(LINES, list(zip(*out)))
            block += 1
    return run


def _joined(table: pa.Table, column: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed arrays of all rows in one, and their lengths."""
    parts = [unpack(v, dtype) for v in table.column(column).to_pylist()]
    return np.concatenate(parts), np.array(list(map(len, parts)))


def _index(least_docs: int):
    def run(table: pa.Table) -> pa.Table:
        """One shard: equal (hash, fingerprint) pairs are summed, then laid out in perfect-hash order."""
        (hashes, _), (prints, _) = _joined(table, "hashes", np.uint64), _joined(table, "prints", np.uint64)
        (docs, _), (tops, _) = _joined(table, "docs", np.uint32), _joined(table, "tops", np.int64)
        order = np.lexsort((prints, hashes))
        hashes, prints = hashes[order], prints[order]
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (prints[1:] != prints[:-1])])
        docs = np.add.reduceat(docs[order].astype(np.int64), first)
        tops = np.maximum.reduceat(tops[order], first)
        hashes, prints = hashes[first], prints[first]
        levels, rest = build(hashes)
        place = places(hashes, levels)
        place[rest] = len(hashes) - len(rest) + np.arange(len(rest))
        at = np.empty(len(hashes), np.int64)
        at[place] = np.arange(len(hashes))
        often = np.flatnonzero(docs[at] >= least_docs)
        row = [table.column("shard")[0].as_py(), len(hashes), pack([len(b) for b in levels], np.int64),
               pack_text(np.packbits(np.concatenate(levels)).tobytes()), pack(prints[at], np.uint32),
               pack(docs[at], np.uint32), pack(often, np.uint32), pack(tops[at[often]], np.int64),
               pack(np.stack([hashes[rest], prints[rest]], 1).ravel(), np.uint64)]
        return pa.Table.from_batches([record_batch(INDEX, [[v] for v in row])])
    return run


class Shard:
    """The decoded arrays of one shard."""

    def __init__(self, row: dict):
        sizes = unpack(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(unpack_text(row["bits"]), np.uint8))[:sizes.sum()].astype(bool)
        self.levels = np.split(bits, np.cumsum(sizes)[:-1])
        self.prints, self.docs = unpack(row["prints"], np.uint32), unpack(row["docs"], np.uint32)
        self.often, self.keepers = unpack(row["often"], np.uint32), unpack(row["keepers"], np.int64)
        rest = unpack(row["rest"], np.uint64).reshape(-1, 2)
        self.rest = {tuple(pair): len(self.docs) - len(rest) + i for i, pair in enumerate(rest.tolist())}

    def find(self, hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The place of each line, -1 if it is not in the set."""
        place = places(hashes, self.levels)
        found = place >= 0
        found[found] = self.prints[place[found]] == prints[found].astype(np.uint32)
        place[~found] = -1
        if self.rest:
            for i, pair in enumerate(zip(hashes.tolist(), prints.tolist())):
                place[i] = self.rest.get(pair, place[i])
        return place


DROPS = pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("keepers", pa.binary())])


def _probe(least_docs: int):
    def run(lines: pa.Table, index: pa.Table) -> pa.Table:
        out = []
        if lines.num_rows:
            shard = Shard(index.to_pylist()[0])
            (hashes, sizes), (prints, _) = _joined(lines, "hashes", np.uint64), _joined(lines, "prints", np.uint64)
            place = shard.find(hashes, prints)
            drop = (place >= 0) & (shard.docs[place] >= least_docs)
            cut = starts_of(sizes)
            for i, (block, numbers) in enumerate(zip(lines.column("block").to_pylist(), lines.column("numbers").to_pylist())):
                mine = np.flatnonzero(drop[cut[i]:cut[i + 1]])
                if len(mine):
                    keeper = shard.keepers[np.searchsorted(shard.often, place[cut[i] + mine])]
                    out.append((block, pack(unpack(numbers, np.uint32)[mine], np.uint32), pack(keeper, np.int64)))
        return pa.Table.from_batches([record_batch(DROPS, list(zip(*out)) or [[]] * 3)])
    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.binary())])


def _finish(least_chars: int):
    def run(blocks: pa.Table, drops: pa.Table) -> pa.Table:
        out = []
        keeper_of: dict[int, int] = {}
        for numbers, keepers in zip(drops.column("numbers").to_pylist(), drops.column("keepers").to_pylist()):
            keeper_of.update(zip(unpack(numbers, np.uint32).tolist(), unpack(keepers, np.int64).tolist()))
        for row in blocks.to_pylist():
            cut, flat = starts_of(unpack(row["sizes"], np.int64)).tolist(), unpack_text(row["texts"])
            texts = [flat[s:e] for s, e in zip(cut, cut[1:])]
            _, lines = numbered(texts, least_chars)
            for doc_id, text, numbers in zip(unpack(row["ids"], np.int64).tolist(), texts, lines):
                stay = [keeper_of.get(k, doc_id) == doc_id for k in numbers]
                if not all(stay):
                    text = b"\n".join(line for line, ok in zip(text.split(b"\n"), stay) if ok)
                out.append((None if doc_id == NO_ID else doc_id, len(stay), len(stay) - sum(stay), text))
        return pa.Table.from_batches([record_batch(KEPT, list(zip(*out)) or [[]] * 4)])
    return run


def scan_lines(docs: DataFrame, store: Store, shards: int | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The written blocks: a row per block and shard with its keys, and a row per block with its packed texts."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return store.save("line_blocks", narrow.mapInArrow(_scan(shards, least_chars), LINES_DDL)).df


def line_index(lines: DataFrame, store: Store, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The written index: one row per shard. Shards are as many as shuffle partitions, so their size is set there."""
    keys = lines.where("shard >= 0").select("shard", "hashes", "prints", "docs", "tops")
    return store.save("line_index", keys.groupBy("shard").applyInArrow(_index(least_docs), INDEX_DDL)).df


def deduplicated_lines(docs: DataFrame, store: Store | None = None, least_chars: int = LEAST_CHARS,
                       least_docs: int = LEAST_DOCS, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and the text that is left."""
    store = store or Store(docs.sparkSession)
    lines = scan_lines(docs, store, shards, least_chars)
    index = line_index(lines, store, least_docs)
    probes = lines.where("shard >= 0").select("shard", "block", "numbers", "hashes", "prints")
    drops = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(
        _probe(least_docs), "block bigint, numbers binary, keepers binary")
    blocks = lines.where("shard < 0").select("block", "ids", "sizes", "texts")
    return blocks.groupBy("block").cogroup(drops.groupBy("block")).applyInArrow(
        _finish(least_chars), "doc_id bigint, n_lines bigint, n_dropped bigint, text binary")
