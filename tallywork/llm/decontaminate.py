"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: each segment holds the postings of a bounded amount of text, as sorted terms, their
counts, and the delta-coded positions of every token. Segments are built and searched where they lie, so no posting
crosses a shuffle and the list of a very frequent term is spread over all segments.

The test items are cut into windows by Spark tasks and written in blocks of bounded size, however long one item is; each
block is sent to all tasks in turn. Terms are ordered
by their count in the whole corpus. A segment starts with the list of a window's rarest term, shifted by its place in
the window, and intersects it with the shifted lists of the next rarer terms; all windows advance together, one sorted
search per rank. What is left after the last term are exact phrases. The same lists give proximity matches: all terms
of the window, in any order, within ``slop`` more words than the window has.

Defined cases: a NULL or empty text has no words, and a document without words has no hit. An item without words has no
window. Items with one id count as one; an item without id is named ``null``. Repeated rows are documents of their own
with equal results. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..sources.store import Store
from .packing import pack, pack_text, ranges, record_batch, starts_of, text_blocks, unpack, unpack_text

WINDOW, SLOP = 10, 5
BLOCK_WINDOWS = 200_000  # windows that are sent to the tasks at once
WORD_SIZE = 6  # bytes of a word and a space, to foresee the number of windows
# A byte belongs to a word if it is a digit, a letter (lower-cased here) or part of a code point beyond ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
SEGMENT = pa.schema([("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32())), ("terms", pa.binary()),
                     ("counts", pa.binary()), ("low", pa.binary()), ("high_at", pa.binary()), ("high", pa.binary())])
SEGMENT_DDL = ("doc_ids array<bigint>, doc_words array<int>, terms binary, counts binary, low binary, high_at binary, "
               "high binary")
HITS = pa.schema([("segment", pa.int64()), ("doc_no", pa.int32()), ("starts", pa.list_(pa.int32())),
                  ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])
HITS_DDL = ("segment bigint, doc_no int, starts array<int>, ends array<int>, items array<string>, "
            "near_items array<string>")
BLOCK = pa.schema([("vocabulary", pa.binary()), ("terms", pa.binary()), ("items", pa.list_(pa.string())),
                   ("item_of", pa.binary())])
BLOCK_DDL = "vocabulary binary, terms binary, items array<string>, item_of binary"


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORD_BYTES).split()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_blocks(batches, "text"):
        ids: dict[bytes, int] = {}
        lengths, tokens = [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
        token = np.concatenate(tokens)
        terms = sorted(ids)
        place = np.empty(len(ids), np.int32)
        place[[ids[t] for t in terms]] = np.arange(len(ids), dtype=np.int32)
        token = place[token]
        order = np.argsort(token, kind="stable")
        counts = np.bincount(token, minlength=len(terms))
        deltas = np.diff(order, prepend=0)
        first = starts_of(counts)[:-1]
        deltas[first] = order[first]
        high_at = np.flatnonzero(deltas > 0xFFFF)
        yield record_batch(SEGMENT, [
            [[r[0] for r in rows]], [lengths], [pack_text(b"\n".join(terms))], [pack(counts, np.uint32)],
            [pack(deltas & 0xFFFF, np.uint16)], [pack(high_at, np.uint32)], [pack(deltas[high_at] >> 16, np.uint32)]])


def build_index(docs: DataFrame, store: Store) -> DataFrame:
    """The written index: one row per segment."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    built = narrow.mapInArrow(_segments, SEGMENT_DDL)
    return store.save("positional_index", built.select(F.monotonically_increasing_id().alias("segment"), "*")).df


@dataclass
class Windows:
    """A block of test windows. ``terms[w, j]`` is a place in ``vocabulary``, or -1 past the end of a short window;
    ``order[w]`` lists its places from the rarest term on."""

    vocabulary: list[bytes]
    terms: np.ndarray
    sizes: np.ndarray
    items: list[str]
    item_of: np.ndarray
    order: np.ndarray | None = None


def _cut(size: int, limit: int):
    """Cuts items into windows and the windows into blocks. Equal windows of one item are kept once in a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, tuple], None] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    rows[name, tuple(words[at:at + size])] = None
                    if len(rows) == limit:
                        yield _packed(list(rows), size)
                        rows = {}
        if rows:
            yield _packed(list(rows), size)
    return run


def _packed(rows: list[tuple[str, tuple]], size: int) -> pa.RecordBatch:
    vocabulary = sorted({w for _, words in rows for w in words})
    place = {w: i for i, w in enumerate(vocabulary)}
    names = sorted({n for n, _ in rows})
    name_at = {n: i for i, n in enumerate(names)}
    terms = np.full((len(rows), size), -1, np.int32)
    for i, (_, words) in enumerate(rows):
        terms[i, :len(words)] = [place[w] for w in words]
    return record_batch(BLOCK, [[pack_text(b" ".join(vocabulary))], [pack(terms, np.int32)], [names],
                                [pack([name_at[n] for n, _ in rows], np.int32)]])


def window_blocks(items: DataFrame, size: int, limit: int, store: Store) -> DataFrame:
    """The written blocks: one row per block of at most ``limit`` windows."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"),
                         F.col("text").cast("binary").alias("text"))
    foreseen = (named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (WORD_SIZE * limit) + 1
    cut = named.repartition(foreseen).mapInArrow(_cut(size, limit), BLOCK_DDL)
    return store.save("window_blocks", cut.select(F.monotonically_increasing_id().alias("block"), "*")).df


def windows_of(row: Row, size: int) -> Windows:
    terms = unpack(row.terms, np.int32).reshape(-1, size)
    return Windows(unpack_text(row.vocabulary).split(b" "), terms, (terms >= 0).sum(1).astype(np.int32), row.items_,
                   unpack(row.item_of, np.int32))


def _term_counts(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    wanted = {w: i for i, w in enumerate(vocabulary.value)}
    total = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = unpack(counts, np.uint32)
            for at, term in enumerate(unpack_text(terms).split(b"\n")):
                if term in wanted:
                    total[wanted[term]] += n[at]
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "n"])


def order_by_rarity(index: DataFrame, block: Windows) -> Windows:
    """Adds the order of each window's places by the corpus count of their terms. Only counts of the block's own terms
    reach the driver."""
    vocabulary = index.sparkSession.sparkContext.broadcast(block.vocabulary)
    partial = index.select("terms", "counts").mapInArrow(lambda b: _term_counts(b, vocabulary), "term int, n bigint")
    counts = np.zeros(len(block.vocabulary), np.int64)
    for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r.term] = r.n
    vocabulary.destroy()
    rarity = np.where(block.terms >= 0, counts[np.maximum(block.terms, 0)], np.iinfo(np.int64).max)
    block.order = np.argsort(rarity, axis=1, kind="stable").astype(np.int32)
    return block


class Segment:
    """The decoded lists of one segment as one sorted array of ``term * span + position``."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.doc_starts = starts_of(np.array(row["doc_words"], np.int64))
        self.terms = unpack_text(row["terms"]).split(b"\n")
        counts = unpack(row["counts"], np.uint32).astype(np.int64)
        self.starts = starts_of(counts)
        deltas = unpack(row["low"], np.uint16).astype(np.int64)
        deltas[unpack(row["high_at"], np.uint32)] += unpack(row["high"], np.uint32).astype(np.int64) << 16
        self.span = int(self.doc_starts[-1]) + 1
        running = np.cumsum(deltas)
        first = self.starts[:-1]
        before = np.concatenate([[0], running])[first] if len(running) else np.zeros(0, np.int64)
        self.positions = running - np.repeat(before, counts)
        self.keys = self.positions + np.repeat(np.arange(len(counts)) * self.span, counts)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, position, "right") - 1

    def known(self, block: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose terms all occur here, and the term numbers of all windows."""
        here = {t: i for i, t in enumerate(self.terms)}
        number = np.array([here.get(w, -1) for w in block.vocabulary] + [0], np.int64)
        terms = number[block.terms]  # -1 in the block is the added last entry
        return np.flatnonzero((terms >= 0).all(1)), terms

    def anchors(self, block: Windows, windows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of each window's rarest term."""
        rarest = terms[windows, block.order[windows, 0]]
        n = self.starts[rarest + 1] - self.starts[rarest]
        return np.repeat(windows, n), self.positions[ranges(self.starts[rarest], n)]

    def phrases(self, block: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        windows, terms = self.known(block)
        window, position = self.anchors(block, windows, terms)
        start = position - block.order[window, 0]
        ok = (start >= 0) & (start + block.sizes[window] < self.span)
        window, start = window[ok], start[ok]
        for rank in range(1, block.terms.shape[1]):
            if not len(window):
                break
            place = block.order[window, rank]
            wanted = terms[window, place] * self.span + start + place
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = (self.keys[at] == wanted) | (rank >= block.sizes[window])
            window, start = window[ok], start[ok]
        ok = self.doc_of(start) == self.doc_of(start + block.sizes[window] - 1)
        return window[ok], start[ok]

    def near(self, block: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of occurrences of the rarest term that lie in a proximity match."""
        windows, terms = self.known(block)
        window, position = self.anchors(block, windows, terms)
        for rank in range(1, block.terms.shape[1]):
            if not len(window):
                break
            reach = block.sizes[window] + slop - 1
            term = terms[window, block.order[window, rank]] * self.span
            last = np.searchsorted(self.keys, term + np.minimum(position + reach, self.span - 1), "right")
            first = np.searchsorted(self.keys, term + np.maximum(position - reach, 0))
            ok = (last > first) | (rank >= block.sizes[window])
            window, position = window[ok], position[ok]
        ok = [self._within(terms[w, :block.sizes[w]], int(p), int(block.sizes[w]) + slop)
              for w, p in zip(window.tolist(), position.tolist())]
        ok = np.array(ok, bool)
        return window[ok], position[ok]

    def _within(self, terms: np.ndarray, at: int, width: int) -> bool:
        """Whether some ``width`` words of one document around ``at`` hold all the terms, each as often as asked."""
        doc = int(self.doc_of(np.array([at]))[0])
        low, high = max(self.doc_starts[doc], at - width + 1), min(self.doc_starts[doc + 1], at + width)
        need = dict(zip(*(x.tolist() for x in np.unique(terms, return_counts=True))))
        seen = []
        for term in need:
            first, last = np.searchsorted(self.keys, [term * self.span + low, term * self.span + high])
            seen += [(p, term) for p in self.positions[first:last].tolist()]
        seen.sort()
        have, short, left = dict.fromkeys(need, 0), len(need), 0
        for p, term in seen:
            have[term] += 1
            short -= have[term] == need[term]
            while seen[left][0] <= p - width:
                gone = seen[left][1]
                short += have[gone] == need[gone]
                have[gone] -= 1
                left += 1
            if not short:
                return True
        return False


def _search(block, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(**block.value)
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                if not len(segment.positions):
                    continue
                window, start = segment.phrases(windows)
                near_window, near_at = segment.near(windows, slop)
                cover = np.zeros(segment.span + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + windows.sizes[window], -1)
                doc, near_doc = segment.doc_of(start), segment.doc_of(near_at)
                hit = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
                begins, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
                out = []
                for d in np.unique(np.concatenate([doc, near_doc])).tolist():
                    base, after = segment.doc_starts[d], segment.doc_starts[d + 1]
                    # A run of hit words may go on into the next document.
                    mine = (begins < after) & (ends > base)
                    names = {windows.items[i] for i in windows.item_of[window[doc == d]].tolist()}
                    near = {windows.items[i] for i in windows.item_of[near_window[near_doc == d]].tolist()}
                    out.append((row["segment"], d, np.maximum(begins[mine] - base, 0).tolist() if names else [],
                                (np.minimum(ends[mine], after) - base).tolist() if names else [], sorted(names),
                                sorted(near)))
                if out:
                    yield record_batch(HITS, list(zip(*out)))
    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP,
                  store: Store | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, spans of hit words (start and end word), items found as exact phrases and
    items found by proximity."""
    spark = docs.sparkSession
    store = store or Store(spark)
    index = build_index(docs, store)
    blocks = window_blocks(items, window, block_windows, store).withColumnRenamed("items", "items_")
    found = None
    for number in [r.block for r in blocks.select("block").collect()]:  # one number a block
        block = windows_of(blocks.where(F.col("block") == number).first(), window)
        sent = spark.sparkContext.broadcast(vars(order_by_rarity(index, block)))
        part = store.save("phrase_hits", index.mapInArrow(_search(sent, slop), HITS_DDL)).df
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    all_docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("doc_no", "doc"))
    base = all_docs.select("segment", "doc_no", F.col("doc.doc_ids").alias("doc_id"),
                           F.col("doc.doc_words").cast("bigint").alias("n_words"))
    empty = {"spans": "array<struct<start:int,end:int>>", "items": "array<string>", "near_items": "array<string>"}
    if found is None:
        return base.select("doc_id", "n_words", *[F.array().cast(t).alias(c) for c, t in empty.items()])
    per_doc = found.groupBy("segment", "doc_no").agg(
        F.sort_array(F.flatten(F.collect_list(F.expr("arrays_zip(starts, ends)")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))
    joined = base.join(per_doc, ["segment", "doc_no"], "left")
    return joined.select("doc_id", "n_words", *[F.coalesce(c, F.array()).cast(t).alias(c) for c, t in empty.items()])


def covered_words(spans: Column) -> Column:
    """Words under sorted spans, each word once."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
        F.greatest(acc["upto"], s["end"]).alias("upto"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"].cast("bigint"))


def clean_documents(docs: DataFrame, items: DataFrame, store: Store | None = None) -> DataFrame:
    """The documents without a hit word, with their own columns. Rows are known by a hash of id and text, so a clean text
    stays when another one with its id goes. The rows to drop are written first, so Spark knows their size when it plans
    the join."""
    store = store or Store(docs.sparkSession)
    key = F.xxhash64(docs["doc_id"], docs["text"])
    found = contamination(docs.select(key.alias("doc_id"), docs["text"].alias("text")), items, store=store)
    drop = store.save("contaminated_rows", found.where(F.size("items") > 0).select(F.col("doc_id").alias("_hit_row")).distinct()).df
    return docs.join(drop, key == drop["_hit_row"], "left_anti")
