"""Exact substring dedup with super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash among its runs of ``SEED_WORDS`` words.
Consecutive windows with one minimiser travel as one packed string of words to the bucket of the minimiser, so equal
windows always meet. A block of documents sends each distinct string once, from its smallest (id, start); the other
copies in the block are known to repeat and travel as positions only. So a passage that is in every document reaches
its bucket once per block. In the bucket the windows are sorted by a hash of their bytes, taken from prefix sums; windows
with one hash are compared in full, and all but the smallest (id, start) of equal ones are marked. Marked windows go back to their documents as word ranges.

Buckets are as many as four times the shuffle partitions, so their size is set there.

Defined cases: a NULL or empty text has no words; fewer words than a window means no window. Rows with one id and one
text are one document: windows at the same place do not repeat each other, and both rows lose the same words. A NULL id
comes before all others. An empty table gives an empty result. A text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Store
from .packing import pack, pack_text, ranges, record_batch, starts_of, text_blocks, unpack, unpack_text

WINDOW, SEED_WORDS = 20, 4
BUCKETS_A_PARTITION = 4
PIECE_BYTES = 1 << 20  # bytes hashed at once in a block
NO_ID = -(1 << 63)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd constant with well spread bits

PACKED = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()),
                    ("prints", pa.binary()), ("starts", pa.binary()), ("again_ids", pa.binary()),
                    ("again_prints", pa.binary()), ("again_starts", pa.binary()), ("again_sizes", pa.binary())])
PACKED_DDL = ("bucket int, words binary, sizes binary, ids binary, prints binary, starts binary, again_ids binary, "
              "again_prints binary, again_starts binary, again_sizes binary")
RANGES = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def chained(values: np.ndarray, length: int, join) -> np.ndarray:
    """``join`` over every run of ``length`` neighbours, by doubling: join(left, right, right's length)."""
    out, done, part, size = None, 0, values, 1
    while length:
        if length & 1:
            if out is None:
                out, done = part, size
            else:
                n = len(part) - done
                out, done = join(out[:max(n, 0)], part[done:], size), done + size
        length >>= 1
        if length:
            part = join(part[:max(len(part) - size, 0)], part[size:], size)
            size *= 2
    return out


def _rolled(left: np.ndarray, right: np.ndarray, right_size: int) -> np.ndarray:
    n = min(len(left), len(right))
    factor = np.uint64(pow(int(MULTIPLY), right_size, 1 << 64))
    return left[:n] * factor + right[:n]


def _least(left: np.ndarray, right: np.ndarray, _: int) -> np.ndarray:
    n = min(len(left), len(right))
    return np.minimum(left[:n], right[:n])


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLY
    return x ^ (x >> np.uint64(29))


def super_kmers(hashes: np.ndarray, lengths: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(first word, words, minimiser) of each run of windows with one minimiser. ``hashes`` are those of the words of
    all documents in a row, ``lengths`` the words of each document."""
    n_windows = np.maximum(lengths - window + 1, 0)
    if not n_windows.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = chained(spread(chained(hashes, seed, _rolled)), window - seed + 1, _least)
    starts = starts_of(lengths)[:-1]
    window_at = ranges(starts, n_windows)
    value = least[window_at]
    new = np.r_[True, (value[1:] != value[:-1]) | (window_at[1:] != window_at[:-1] + 1)]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(value)])
    return window_at[first], count + window - 1, value[first]


def _powers(base: int):
    """Powers of an odd number modulo 2^64, kept and extended as needed: of(n) has at least n of them."""
    table = np.ones(1, np.uint64)

    def of(n: int) -> np.ndarray:
        nonlocal table
        if n > len(table):
            table = np.full(max(n, 2 * len(table)), base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
        return table
    return of


def byte_hasher():
    """hashes(data, begin, end): one number for each byte range, equal for equal ranges, from prefix sums over the
    bytes. Both ends of the ranges ascend. Different ranges may share a number. The sums are taken over pieces of about
    ``PIECE_BYTES``, so that they stay small."""
    up, down = _powers(int(MULTIPLY)), _powers(pow(int(MULTIPLY), -1, 1 << 64))

    def piece(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(data, up(n)[:n], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        return spread((sums[end] - sums[begin]) * down(n + 1)[begin])

    def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        cuts = np.searchsorted(begin, np.arange(0, len(data), PIECE_BYTES)).tolist()
        out = np.empty(len(begin), np.uint64)
        for low, high in zip(cuts, [*cuts[1:], len(begin)]):
            if low < high:
                origin = begin[low]
                out[low:high] = piece(data[origin:end[high - 1]], begin[low:high] - origin, end[low:high] - origin)
        return out
    return hashes


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text with single spaces begin and end. The text is not empty."""
    spaces = np.flatnonzero(data == 32)
    return np.r_[0, spaces + 1], np.r_[spaces, len(data)]


def _scan(buckets: int, window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = byte_hasher()
        for rows, texts in text_blocks(batches, "text"):
            lengths = np.empty(len(texts), np.int64)
            for at, text in enumerate(texts):
                words = text.split()
                lengths[at], texts[at] = len(words), b" ".join(words)
            text = b" ".join([t for t in texts if t])
            del texts
            if not text:
                continue
            data = np.frombuffer(text, np.uint8)
            begin, end = word_places(data)
            first, size, least = super_kmers(hashes(data, begin, end), lengths, window, seed)
            if not len(first):
                continue
            doc_starts = starts_of(lengths)
            doc = np.searchsorted(doc_starts, first, "right") - 1
            ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)[doc]
            prints = np.array([r[1] for r in rows], np.int64)[doc]
            start = first - doc_starts[doc]
            order = np.lexsort((start, ids))  # the smallest place of a string comes first
            seen: dict[bytes, int] = {}
            head = np.empty(len(first), np.int64)
            for k, s, e in zip(order.tolist(), begin[first[order]].tolist(), end[first[order] + size[order] - 1].tolist()):
                head[k] = seen.setdefault(text[s:e], k)
            sent = np.fromiter(seen.values(), np.int64, len(seen))
            strings = list(seen)
            again = (head != np.arange(len(head))) & ((ids != ids[head]) | (start != start[head]))
            bucket = (spread(least) % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket[sent], kind="stable")
            cut = starts_of(np.bincount(bucket[sent], minlength=buckets))
            copies = np.flatnonzero(again)
            copies = copies[np.argsort(bucket[copies], kind="stable")]
            copy_cut = starts_of(np.bincount(bucket[copies], minlength=buckets))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = by_bucket[cut[b]:cut[b + 1]]
                k, c = sent[own], copies[copy_cut[b]:copy_cut[b + 1]]
                row = (b, pack_text(b" ".join([strings[i] for i in own.tolist()])), pack(size[k], np.uint32),
                       pack(ids[k], np.int64), pack(prints[k], np.int64), pack(start[k], np.uint32),
                       pack(ids[c], np.int64), pack(prints[c], np.int64), pack(start[c], np.uint32),
                       pack(size[c], np.uint32))
                yield record_batch(PACKED, [[v] for v in row])
    return run


def repeats(texts: list[bytes], sizes: list[np.ndarray], ids: np.ndarray, starts: np.ndarray,
            window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window in it) of every window whose words also start at a smaller (id, start). Each text holds strings
    with single spaces between all words, ``sizes`` the words of its strings; ids and starts are those of all strings."""
    hashes, held, begins, ends = byte_hasher(), [], [], []
    for text, own in zip(texts, sizes):
        data = np.frombuffer(text, np.uint8)
        begin, end = word_places(data)
        at = ranges(starts_of(own)[:-1], own - window + 1)
        begin, end = begin[at], end[at + window - 1]
        held.append(hashes(data, begin, end))
        begins.append(begin.astype(np.uint32))
        ends.append(end.astype(np.uint32))
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in held])
    rolled, begin, end = np.concatenate(held), np.concatenate(begins), np.concatenate(ends)
    del held, begins, ends
    order = np.argsort(rolled)
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    twice = order[np.r_[same, False] | np.r_[False, same]]  # a hash that occurs once is a window that occurs once
    del rolled, ranked, order, same
    if not len(twice):
        return twice, twice
    numbers: dict[bytes, int] = {}
    group = np.fromiter((numbers.setdefault(texts[t][b:e], len(numbers)) for t, b, e in
                         zip(text_of[twice].tolist(), begin[twice].tolist(), end[twice].tolist())), np.int64, len(twice))
    del numbers
    before = starts_of(np.concatenate(sizes) - window + 1)
    string = np.searchsorted(before, twice, "right") - 1
    offset = twice - before[string]
    place = starts[string] + offset
    order = np.lexsort((place, ids[string], group))
    group, by_id, by_place = group[order], ids[string][order], place[order]
    first = np.r_[True, group[1:] != group[:-1]]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (by_id != by_id[head]) | (by_place != by_place[head])
    return string[order[later]], offset[order[later]]


def _bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        def parts(column: str, dtype) -> list[np.ndarray]:
            return [unpack(v, dtype) for v in table.column(column).to_pylist()]

        def joined(column: str, dtype) -> np.ndarray:
            return np.concatenate(parts(column, dtype))

        texts = [unpack_text(v.as_py()) for v in table.column("words")]
        ids, prints = joined("ids", np.int64), joined("prints", np.int64)
        starts = joined("starts", np.uint32).astype(np.int64)
        string, offset = repeats(texts, [s.astype(np.int64) for s in parts("sizes", np.uint32)], ids, starts, window)
        del texts
        begin = np.r_[starts[string] + offset, joined("again_starts", np.uint32).astype(np.int64)]
        end = np.r_[starts[string] + offset + window,
                    joined("again_starts", np.uint32).astype(np.int64) + joined("again_sizes", np.uint32)]
        ids, prints = np.r_[ids[string], joined("again_ids", np.int64)], np.r_[prints[string], joined("again_prints", np.int64)]
        if not len(begin):
            return pa.Table.from_batches([record_batch(RANGES, [[]] * 4)])
        order = np.lexsort((begin, prints, ids))  # touching ranges of one document become one
        ids, prints, begin, end = ids[order], prints[order], begin[order], end[order]
        doc = np.cumsum(np.r_[True, (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])])
        reach = np.maximum.accumulate(end + doc * (1 << 40)) - doc * (1 << 40)
        new = np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])]
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(new)] - 1
        return pa.Table.from_batches([record_batch(RANGES, [ids[head], prints[head], begin[head].astype(np.int32),
                                                            reach[last].astype(np.int32)])])
    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, lost, texts = [], [], []
        for value, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            words = value.as_buffer().to_pybytes().split() if value.is_valid else []
            counts.append(len(words))
            if spans:
                kept, upto = [], 0
                for span in sorted((s["start"], s["end"]) for s in spans):
                    kept += words[upto:max(span[0], upto)]
                    upto = max(upto, span[1])
                words = kept + words[upto:]
            lost.append(counts[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()),
                                          pa.array(texts, pa.binary())], ["doc_id", "n_words", "n_removed", "text"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, buckets: int | None = None) -> DataFrame:
    """(id, print, start, end): word ranges of repeated windows. ``id`` is never NULL; ``print`` is the text's hash."""
    buckets = buckets or BUCKETS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print"),
                       F.col("text").cast("binary").alias("text"))
    packed = rows.mapInArrow(_scan(buckets, window, seed), PACKED_DDL)
    return packed.groupBy("bucket").applyInArrow(_bucket(window), "id bigint, print bigint, start int, end int")


def without_repeats(docs: DataFrame, store: Store | None = None, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words, joined by one space."""
    store = store or Store(docs.sparkSession)
    found = store.save("repeated_ranges", repeated_ranges(docs, window, buckets=buckets)).df
    spans = found.groupBy("id", "print").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("print"),
                        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("bigint").alias("id"))
    joined = keyed.join(spans, ["id", "print"], "left").select("doc_id", "text", "spans")
    out = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("text", T.BinaryType())])
    return joined.mapInArrow(_removed, out)
