"""URL filter over a sorted digest array.

The list is a table of entries and verdicts. Spark hashes the entries to 64-bit xxHash keys, deals them out by ranges of
the keys, and writes each range sorted, as one part. Executors fetch the parts as Spark files; the first task of an
executor lays each one out once as a file of keys, string offsets and strings, which all tasks memory-map. Tasks build
all keys a URL can match (host and parent domains, each with the path heads of the lengths that occur in the list), find
them with one vectorised binary search per part and batch, and confirm each hit on the stored string, so a digest
collision cannot give a verdict. Neither the entries nor the parts pass through the driver, which only names the files.

Entries: ``host/path`` with a verdict (a rule fits its host and all subdomains, for URLs whose path starts with the
rule's; the longest entry wins, the longer host among equals), and ``label:word`` for blocked words. A URL that no
rule fits is blocked if a part of a host label is a blocked word, else allowed.

Defined cases: an entry without ``/`` fits every path of its host; an entry with two verdicts blocks; NULL entries are left
out. Columns other than page_id and url are not read, and a URL of any length is taken whole. A NULL URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. An empty
table or an empty list gives no hits. Repeated rows get equal verdicts.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Store

# The rules and the blocked words of the production list.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block",
         "net/fr/": "block"}
BLOCKED_WORDS = ("adult", "ads", "bet", "bets", "bingo", "casino", "escort", "gamble", "gambling", "jackpot", "malware",
                 "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx")
PARTS = re.compile(r"[-_.]+")
HEADER = "<qq"  # entries, bytes of the strings
SEED = 42  # fixed value: the seed of Spark's xxhash64
ENTRIES_A_PART = 1 << 20


def digests(keys: list[bytes]) -> np.ndarray:
    """The keys as Spark's ``xxhash64`` gives them: signed, with its seed."""
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys)).view(np.int64)


def laid_out(keys: np.ndarray, strings: list[bytes]) -> bytes:
    """The file of a part: header, sorted digests, string offsets, strings."""
    ends = np.cumsum([0, *map(len, strings)]).astype(np.int64)
    blob = b"".join(strings)
    return struct.pack(HEADER, len(keys), len(blob)) + keys.tobytes() + ends.tobytes() + blob


def encoded(entries: dict[str, str]) -> bytes:
    """A small list as the file of one part. A string is the entry, a line feed and its verdict."""
    keys = [k.encode() for k in entries]
    order = np.argsort(digests(keys), kind="stable")
    return laid_out(digests([keys[i] for i in order]), [keys[i] + b"\n" + entries[keys[i].decode()].encode() for i in order])


class DigestArray:
    """A memory-mapped list."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, size = struct.unpack(HEADER, data[:16].tobytes())
        at = 16
        self.keys = data[at:at + 8 * n].view(np.int64)
        self.ends = data[at + 8 * n:at + 8 * (2 * n + 1)].view(np.int64)
        self.strings = data[at + 8 * (2 * n + 1):][:size]

    def find(self, keys: list[bytes]) -> list[str | None]:
        """The verdict of each key that is in the list."""
        found: list[str | None] = [None] * len(keys)
        if not len(self.keys) or not keys:
            return found
        wanted = digests(keys)
        at = np.searchsorted(self.keys, wanted)
        near = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
        for i in near.tolist():
            place = int(at[i])
            while place < len(self.keys) and self.keys[place] == wanted[i]:  # entries with one digest lie together
                entry, _, verdict = self.strings[self.ends[place]:self.ends[place + 1]].tobytes().rpartition(b"\n")
                if entry == keys[i]:
                    found[i] = verdict.decode()
                    break
                place += 1
        return found


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    head = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = head.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def candidates(host: str, path: str, heads: list[int]) -> list[str]:
    """Every rule that could fit, longest first: the host and its parents, each with heads of the path."""
    labels = host.split(".") if host else []
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    pairs = [(h, path[:n]) for h in hosts for n in heads if n <= len(path)]
    return [h + p for h, p in sorted(pairs, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def entry_table(spark: SparkSession, rules: dict[str, str], blocked_words=()) -> DataFrame:
    """A list given in the program as a table: (entry, verdict)."""
    rows = [*rules.items(), *[(f"label:{w}", "block") for w in blocked_words]]
    return spark.createDataFrame(rows, "entry string, verdict string")


def publish(entries: DataFrame, store: Store, entries_a_part: int = ENTRIES_A_PART) -> list[str]:
    """Writes the list in parts, ranges of the digest, sorted, and hands them to the executors; the names of the files."""
    spark = entries.sparkSession
    known = entries.where("entry IS NOT NULL").groupBy("entry").agg(F.max("verdict").alias("verdict"))
    keyed = store.save("url_entries", known.select(
        F.xxhash64("entry").alias("digest"), F.concat_ws("\n", "entry", "verdict").cast("binary").alias("string")))
    folder, run = store.path("url_list"), uuid.uuid4().hex
    parts = keyed.rows // entries_a_part + 1
    dealt = keyed.df.repartitionByRange(parts, "digest").sortWithinPartitions("digest")
    dealt.write.option("compression", "none").parquet(folder)
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = new_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for status in fs.listStatus(new_path(folder)):
        if status.getPath().getName().endswith(".parquet"):
            names.append(f"urls-{run}-{len(names)}.list")
            path = new_path(folder, names[-1])
            fs.rename(status.getPath(), path)
            spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return names


def mapped(part: str) -> str:
    """The file to map of a fetched part; the first task of an executor that asks makes it."""
    made = f"{part}.map"
    if not os.path.exists(made):
        table = pq.read_table(part)
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(part), delete=False) as f:
            f.write(laid_out(table["digest"].to_numpy(), table["string"].to_pylist()))
        os.replace(f.name, made)
    return made


class DigestParts:
    """The mapped parts of a list; a key is looked for in the part whose range holds its digest."""

    def __init__(self, paths: list[str]):
        parts = [p for p in map(DigestArray, paths) if len(p.keys)]
        self.parts = sorted(parts, key=lambda p: p.keys[0])
        self.firsts = np.array([p.keys[0] for p in self.parts], np.int64)

    def find(self, keys: list[bytes]) -> list[str | None]:
        if len(self.parts) < 2:
            return self.parts[0].find(keys) if self.parts else [None] * len(keys)
        part_of = np.searchsorted(self.firsts, digests(keys), "right") - 1
        found: list[str | None] = [None] * len(keys)
        for p in np.unique(part_of[part_of >= 0]).tolist():
            own = np.flatnonzero(part_of == p).tolist()
            for i, verdict in zip(own, self.parts[p].find([keys[i] for i in own])):
                found[i] = verdict
        return found


def _judged(names: list[str], heads: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = DigestParts([mapped(SparkFiles.get(n)) for n in names])
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            rules = [candidates(h, p, heads) for h, p in split]
            words = [[f"label:{w}" for w in PARTS.split(h) if w] for h, _ in split]
            hits = iter(listed.find([k.encode() for r, w in zip(rules, words) for k in (*r, *w)]))
            rule, verdict = [], []
            for r, w in zip(rules, words):
                own = [(k, v) for k, v in [(k, next(hits)) for k in r] if v]
                bad = [v for v in [next(hits) for _ in w] if v]
                rule.append(own[0][0] if own else None)
                verdict.append(own[0][1] if own else bad[0] if bad else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()),
                 pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])
    return run


def judged(pages: DataFrame, rules: dict[str, str] | None = None, blocked_words=BLOCKED_WORDS, entries: DataFrame | None = None,
           store: Store | None = None, entries_a_part: int = ENTRIES_A_PART) -> DataFrame:
    """One row per page: page_id, host, path, the longest rule that fits, verdict. The list is the table ``entries`` (entry,
    verdict), or the rules and words given."""
    spark = pages.sparkSession
    if entries is None:
        entries = entry_table(spark, RULES if rules is None else rules, blocked_words)
    slash = F.instr("entry", "/")
    head = F.when(slash > 0, F.length("entry") - slash + 1).otherwise(0)
    lengths = entries.where("entry NOT LIKE 'label:%'").select(head.alias("head")).distinct()
    heads = sorted(r.head for r in lengths.collect())  # no more than the longest entry has characters
    names = publish(entries, store or Store(spark), entries_a_part)
    texts = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    return pages.select("page_id", "url").mapInArrow(_judged(names, heads),
                                                     T.StructType([pages.schema["page_id"], *texts]))
