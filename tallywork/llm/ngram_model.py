"""Language-model scoring with a log-frequency Bloom filter.

One scan cuts the documents into blocks, numbers the words of each block, and sends to every bucket of words the
block's training counts and word pairs, each distinct word and pair once. A bucket sums them over all blocks. Pairs are
stored in a Bloom filter under their quantised count: a pair seen c times is entered at the levels 1 to 1 + floor(log2
c), so probing level after level until the first miss gives its count to a factor of two. Each bucket fills its own
segment of the filter, sized by its entries at ``BITS_PER_ENTRY``, so every pair is kept and the filter grows with the corpus.
Where all pairs sent fit ``BROADCAST_BYTES`` at that size, the segments are broadcast and blocks probe them. A larger filter
stays where it is built: the blocks' pairs, which are in the bucket already, probe its segment there, and the levels come
back with the word counts. Both give the same scores. Exact word counts are not broadcast: a bucket sends each block those of its own words.

P(w | h) = (c'(h, w) + (c(h) + T(h) - S(h)) p(w)) / (c(h) + T(h)), with c' the quantised count of the filter, T the number of
pairs of h and S the sum of their quantised counts (Witten-Bell), and p the smoothed word probability.

Defined cases: a NULL or empty text is one end token. A NULL id counts as the empty text, whose remainder is 0: held
out. Repeated rows are documents of their own. Without training documents every token is unknown. An empty table gives
an empty result. A text of any length is scored whole; one over ``BLOCK_BYTES`` is a block with what came before it. Other
columns are not read. Ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from .packing import pack, pack_text, record_batch, starts_of, text_blocks, unpack, unpack_text

FOLDS, HELD_OUT = 10, 0
ADDED = 0.1
END = b"\n"  # no word holds white space
BITS_PER_ENTRY, PROBES, LEVELS = 10, 4, 48
BROADCAST_BYTES = 1 << 27
BLOCK_BYTES = 8 << 20  # text of one block
BLOCKS_A_TASK = 1 << 24
TOKENS_AT_ONCE = 1 << 18
MULTIPLY, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # fixed values: odd constants

BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("pairs", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()),
                    ("followers", pa.binary()), ("next_words", pa.binary()), ("pair_counts", pa.binary()),
                    ("ids", pa.binary()), ("known_ids", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary())])
BLOCKS_DDL = ", ".join(f"{f.name} {'bigint' if f.name in ('block', 'pairs') else 'int' if f.name == 'bucket' else 'binary'}"
                       for f in BLOCKS)
VALUES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("segment", pa.binary()), ("tokens", pa.int64()),
                    ("distinct", pa.int64()), ("counts", pa.binary()), ("kept", pa.binary()), ("mass", pa.binary()),
                    ("levels", pa.binary())])
VALUES_DDL = ("block bigint, bucket int, segment binary, tokens bigint, distinct bigint, counts binary, kept binary, mass binary, "
              "levels binary")
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLY
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def short(hashes: np.ndarray) -> np.ndarray:
    """What a pair stores of its second word."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def bits_of(history: np.ndarray, word: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """The places of a pair's level in its segment of ``size`` bits, one probe after the other."""
    x = spread(spread(history) + word.astype(np.uint64) * MULTIPLY + np.uint64(level * int(STEP) & 0xFFFFFFFFFFFFFFFF))
    y = spread(x + STEP) | np.uint64(1)
    for probe in range(PROBES):
        yield (x + y * np.uint64(probe)) % size


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS)


def block_pairs(tokens: np.ndarray, first_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (history * words + word) of a block's tokens in the order in which they travel, the rank of each
    one's history, and the pair of every token."""
    history = np.r_[np.int64(0), tokens[:-1].astype(np.int64)]
    pair, at = np.unique(history * len(first_rank) + tokens, return_inverse=True)
    rank = first_rank[pair // len(first_rank)]
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pair[order], rank[order], place[at]


def _scan(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * BLOCKS_A_TASK
        for rows, texts in text_blocks(batches, "text", BLOCK_BYTES):
            number: dict[bytes, int] = {END: 0}
            lengths, parts = [], []
            for text in texts:
                words = text.lower().split()
                lengths.append(len(words) + 1)
                parts.append(np.array([number.setdefault(w, len(number)) for w in words] + [0], np.int32))
            tokens = np.concatenate(parts)
            words = list(number)
            del number, parts
            trained = np.repeat([not held_out(r[0]) for r in rows], lengths)
            counts = np.bincount(tokens[trained], minlength=len(words))
            hashes = word_hashes(words)
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            by_bucket = np.argsort(bucket, kind="stable")  # the order in which a bucket's values come back
            cut = starts_of(np.bincount(bucket, minlength=buckets))
            rank = np.empty(len(words), np.int64)
            rank[by_bucket] = np.arange(len(words))
            pair, first, at = block_pairs(tokens, rank)
            pair_count = np.bincount(at[trained], minlength=len(pair))  # 0: only held-out documents have it
            followers = np.bincount(first, minlength=len(words))
            pair_cut = starts_of(followers)
            next_words = short(hashes)[pair % len(words)]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                lo, hi = cut[b], cut[b + 1]
                own = by_bucket[lo:hi]
                some = slice(pair_cut[lo], pair_cut[hi])
                yield record_batch(BLOCKS, [[v] for v in (
                    block, b, pair_cut[hi] - pair_cut[lo], pack(hashes[own], np.uint64), pack(counts[own], np.uint32), pack(followers[lo:hi], np.uint32),
                    pack(next_words[some], np.uint32), pack(pair_count[some], np.uint32), None, None, None, None)])
            known = np.array([r[0] is not None for r in rows], np.uint8)
            ids = [0 if r[0] is None else r[0] for r in rows]
            yield record_batch(BLOCKS, [[v] for v in (
                block, -1, 0, pack_text(b" ".join(words)), None, None, None, None, pack(ids, np.int64), pack(known, np.uint8),
                pack(lengths, np.int64), pack(tokens, np.uint32))])
            block += 1
    return run


def found_levels(filled: np.ndarray, hashes: np.ndarray, words: np.ndarray, base=0, size=np.uint64(64),
                 left: np.ndarray | None = None) -> np.ndarray:
    """The level up to which the filter holds each pair (history hash, short word hash), whose segment begins at ``base`` and
    has ``size`` bits (one number, or one a pair); only the pairs at ``left``, by default all, are probed."""
    level, step = np.zeros(len(words), np.uint8), 0
    left = np.arange(len(words)) if left is None else left
    base, size = (np.broadcast_to(v, len(words)) for v in (base, size))
    while len(left) and step < LEVELS:
        step += 1
        at, hit = base[left], np.arange(len(left))
        for place in bits_of(hashes[left], words[left], step, size[left]):
            bit = place[hit].astype(np.int64) + at[hit]
            hit = hit[(filled[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
        left = left[hit]
        level[left] = step
    return level


def _sum_bucket(bits_per_entry: int, probe: bool):
    """The bucket's segment, or, with ``probe``, the levels of every block's pairs from it; and its words' values by block."""
    def run(table: pa.Table) -> pa.Table:
        def joined(column: str, dtype) -> tuple[np.ndarray, list[int]]:
            parts = [unpack(v, dtype) for v in table.column(column).to_pylist()]
            return np.concatenate(parts), list(map(len, parts))

        words, sizes = joined("words", np.uint64)
        distinct, at = np.unique(words, return_inverse=True)
        count = np.bincount(at, joined("counts", np.uint32)[0], len(distinct)).astype(np.int64)
        history = np.repeat(at, joined("followers", np.uint32)[0]).astype(np.uint64)
        key = history << np.uint64(32) | joined("next_words", np.uint32)[0].astype(np.uint64)
        order = np.argsort(key)
        key, times = key[order], joined("pair_counts", np.uint32)[0].astype(np.int64)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key = key[first]
        times = np.add.reduceat(times, first) if len(key) else times
        key, level = key[times > 0], levels_of(times[times > 0])
        segment_bits = max(64, -(-int(level.sum()) * bits_per_entry // 64) * 64)
        size = np.uint64(segment_bits)
        history = (key >> np.uint64(32)).astype(np.int64)
        bits = np.zeros(segment_bits, bool)
        left_history, left_word, left_level = distinct[history], (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), level
        for step in range(1, int(level.max()) + 1 if len(level) else 1):
            for place in bits_of(left_history, left_word, step, size):
                bits[place] = True
            more = left_level > step
            left_history, left_word, left_level = left_history[more], left_word[more], left_level[more]
        kept = np.bincount(history, minlength=len(distinct))
        mass = np.bincount(history, np.ldexp(1.0, level - 1), len(distinct)).astype(np.int64)
        bucket, cut = table.column("bucket")[0].as_py(), starts_of(np.array(sizes))
        filled = np.packbits(bits, bitorder="little")
        del bits, key
        out = [(-1, bucket, None if probe else filled.tobytes(), int(count.sum()), int((count > 0).sum()), None, None,
                None, None)]
        for i, block in enumerate(table.column("block").to_pylist()):
            mine, level = at[cut[i]:cut[i + 1]], None
            if probe:
                h = np.repeat(distinct[mine], unpack(table.column("followers")[i].as_py(), np.uint32))
                w = unpack(table.column("next_words")[i].as_py(), np.uint32)
                level = np.concatenate([np.zeros(0, np.uint8)] + [
                    found_levels(filled, h[lo:lo + TOKENS_AT_ONCE], w[lo:lo + TOKENS_AT_ONCE], size=size)
                    for lo in range(0, len(w), TOKENS_AT_ONCE)])
            out.append((block, bucket, None, None, None, pack(count[mine], np.int64), pack(kept[mine], np.int64),
                        pack(mass[mine], np.int64), None if level is None else pack(level, np.uint8)))
        return pa.Table.from_batches([record_batch(VALUES, list(zip(*out)))])
    return run


def _score(sent, buckets: int, n_tokens: int, n_distinct: int):
    """Scores of a block, with levels from the broadcast filter ``sent`` or, without one, from the block's values."""
    def run(blocks: pa.Table, values: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            hashes = word_hashes(unpack_text(row["words"]).split(b" "))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            every = sorted(values.to_pylist(), key=lambda v: v["bucket"])
            count, kept, mass = (np.empty(len(hashes), np.int64) for _ in range(3))
            for name, array in (("counts", count), ("kept", kept), ("mass", mass)):
                array[by_bucket] = np.concatenate([unpack(v[name], np.int64) for v in every])
            probed = [] if sent else [unpack(v["levels"], np.uint8) for v in every]
            del every
            p_word = (count + ADDED) / (n_tokens + ADDED * (n_distinct + 1))
            tokens = unpack(row["tokens"], np.uint32)
            history = np.r_[np.uint32(0), tokens[:-1]]
            word, log_p = short(hashes), np.empty(len(tokens))
            if sent is None:
                rank = np.empty(len(hashes), np.int64)
                rank[by_bucket] = np.arange(len(hashes))
                _, _, at = block_pairs(tokens, rank)
                all_levels = np.concatenate(probed)[at]
            else:
                filled, sizes = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
                begins = starts_of(sizes)
            for lo in range(0, len(tokens), TOKENS_AT_ONCE):
                h, w = history[lo:lo + TOKENS_AT_ONCE], tokens[lo:lo + TOKENS_AT_ONCE]
                known = (kept[h] > 0) & (count[w] > 0)
                if sent is None:
                    level = np.where(known, all_levels[lo:lo + TOKENS_AT_ONCE], 0).astype(np.int64)
                else:
                    own = bucket[h]
                    level = found_levels(filled, hashes[h], word[w], begins[own], sizes[own].astype(np.uint64),
                                         np.flatnonzero(known)).astype(np.int64)
                pairs = np.where(level > 0, np.ldexp(1.0, level - 1), 0.0)
                # A pair is not more frequent than its words.
                pairs = np.minimum(pairs, np.minimum(count[h], count[w]))
                spare = (count[h] + kept[h] - mass[h]) * p_word[w]
                log_p[lo:lo + TOKENS_AT_ONCE] = np.log10(
                    np.where(count[h] > 0, (pairs + spare) / np.maximum(count[h] + kept[h], 1), p_word[w]))
            begin = starts_of(unpack(row["lengths"], np.int64))[:-1]
            total = lambda x: np.add.reduceat(x, begin).tolist()
            base, score = total(np.log10(p_word)[tokens]), total(log_p)
            n_known = total((count[tokens] > 0).astype(np.int64))
            ids = [i if ok else None for i, ok in zip(unpack(row["ids"], np.int64).tolist(), unpack(row["known_ids"], np.uint8))]
            out += zip(ids, map(held_out, ids), unpack(row["lengths"], np.int64).tolist(), n_known, base, score)
        return pa.Table.from_batches([record_batch(SCORES, list(zip(*out)) or [[]] * 6)])
    return run


def scored(docs: DataFrame, store: Store | None = None, bits_per_entry: int = BITS_PER_ENTRY, buckets: int | None = None,
           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words alone) and score."""
    spark = docs.sparkSession
    store = store or Store(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = store.save("ngram_blocks", narrow.mapInArrow(_scan(buckets), BLOCKS_DDL)).df
    words = blocks.where("bucket >= 0").select("block", "bucket", "words", "counts", "followers", "next_words", "pair_counts")
    large = (blocks.agg(F.sum("pairs")).first()[0] or 0) * bits_per_entry > 8 * broadcast_bytes
    values = store.save("ngram_values", words.groupBy("bucket").applyInArrow(_sum_bucket(bits_per_entry, large), VALUES_DDL)).df
    segments, sent = values.where("block < 0"), None
    held = segments.select("bucket", "tokens", "distinct", F.octet_length("segment").alias("size")).collect()  # one row a bucket
    n_tokens, n_distinct = sum(s.tokens for s in held), sum(s.distinct for s in held)
    if not large:
        sizes = np.zeros(buckets, np.int64)
        for s in held:
            sizes[s.bucket] = s.size
        begin, joined = starts_of(sizes), bytearray(int(sizes.sum()))
        for s in segments.select("bucket", "segment").toLocalIterator():
            joined[begin[s.bucket]:begin[s.bucket + 1]] = s.segment
        sent = spark.sparkContext.broadcast((bytes(joined), sizes * 8))
        del joined
    back = values.where("block >= 0").select("block", "bucket", "counts", "kept", "mass", "levels")
    texts = blocks.where("bucket < 0").select("block", "words", "ids", "known_ids", "lengths", "tokens")
    found = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(sent, buckets, n_tokens, n_distinct), SCORES_DDL)
    scores = store.save("ngram_scores", found).df
    if sent is not None:
        sent.destroy()
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
