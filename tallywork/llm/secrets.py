"""Secret scan: fixed patterns, and password guess costs for values in a credential context.

The patterns find assignments, access keys and hex strings. Every value that follows a credential word (a wider set
than the assignment pattern; a quoted value runs to its closing quote on the line, another one to white space) gets the lowest number of guesses that an
attacker needs, as its base-10 logarithm: a dynamic program cuts the value into dictionary words (with capitals and
look-alike characters), dates, repeats, keyboard walks and brute-force characters at the lowest total cost. A value of
``STRONG`` or more is a real secret and adds a ``guess`` span; "changeme1" and the like do not, nor does code that only
names a value (a call, a subscript, a variable to be filled in, an address). Words and repeats of any length count; a
value of n characters takes up to n * n steps where it repeats itself.

The ranked dictionary is a parameter: the vocabulary file of a public tokenizer, whose order is that of frequency. Only
its first ``MAX_WORDS`` words are sent to the executors.

Spans are in code points, end exclusive; of equal starts the kind listed first comes first. Only doc_id and text are
read, so other columns of any name do not matter. Defined cases: a NULL text is empty and has no spans; a text of any length is
scanned whole; repeated rows get equal spans; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_WORDS = 50_000
STRONG = 8.0
KINDS = ("assign", "access", "hex", "guess")

# The patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
NAMES = r"""(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?)"""
# A name may end a longer word (clientSecret); before " is " only in camel case, as "compass is" is prose.
CONTEXT = re.compile(
    rf"""(?:{NAMES}["']?[\x20\t]*(?:=>|:=|==|[:=])|(?:(?<![a-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z]))){NAMES}["']?[\x20\t]+is[\x20\t])"""
    r"""[\x20\t]*(?:"((?:[^"\\\r\n]|\\[^\r\n])*)"|'((?:[^'\\\r\n]|\\[^\r\n])*)'|["']?([^\s"']\S{5,}))""",
    re.IGNORECASE | re.ASCII)
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential")
HEX_MARK = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))

# The most used passwords, look-alike characters, the rows of a keyboard.
COMMON = ("password", "123456", "12345678", "qwerty", "letmein", "admin", "welcome", "changeme", "secret", "example",
          "dragon", "monkey", "login", "master", "hello", "football", "baseball", "iloveyou", "sunshine", "princess",
          "shadow", "superman", "batman", "trustno", "default", "guest", "test", "root", "user", "sample", "dummy",
          "placeholder", "your", "token", "pass", "none", "null", "true", "false", "undefined")
ALIKE = str.maketrans({"4": "a", "@": "a", "0": "o", "3": "e", "1": "i", "!": "i", "5": "s", "$": "s", "7": "t", "+": "t"})
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

LEAST_WALK = 4
SEGMENT = log10(2)  # each further segment doubles the ways to combine
YEAR, PART = r"(?:19|20)\d\d", (r"\d", r"\d\d")
DATES = [re.compile(YEAR, re.ASCII)] + [
    re.compile(form, re.ASCII) for a in PART for b in PART
    for form in (rf"{YEAR}([-/._]?){a}\1{b}", rf"{a}([-/._]?){b}\1{YEAR}")]
# What stands for a value and is none, and is guessed by its name at a cost of NAMED: in code a call or a subscript of a dotted
# path or of a plain name; anywhere a variable to be filled in, or an address without a user or parameters.
NAMED = 3.0
FILLED_IN = r"""\$\{[\w.:-]+\}|\{\{[\w.:\x20-]+\}\}|%[({]\w+[)}]s?|<[A-Za-z_\x20-]+>|[a-z][a-z+]*://[^\s@"'=]+"""
QUOTED_NAME = re.compile(FILLED_IN, re.ASCII)
BARE_NAME = re.compile(
    r"""[A-Za-z_]+(?:(?:\.|::|->)[A-Za-z_]+)+[(\[]\S*|[A-Za-z_]+(?:\([\w.,="'/-]*\)|\[["'\w.]*\])(?:\.\w+)*(?:\(\))?|\$\(\S+\)|"""
    + FILLED_IN, re.ASCII)
OPENERS = {")": "(", "]": "[", "}": "{"}
PLACES = {c: (row, at) for row, keys in enumerate(KEYBOARD) for at, c in enumerate(keys)}


def read_words(path: str = WORDS_FILE) -> dict[str, int]:
    """Words with their rank: the common passwords, then the letters-only tokens of the vocabulary in its order."""
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    with open(path, "rb") as lines:
        for line in lines:
            word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower()
            if len(word) >= 3 and word.isalpha() and len(ranks) < MAX_WORDS:
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def adjacent(a: str, b: str) -> bool:
    """Neighbouring keys; each row is shifted by half a key against the one above."""
    if a not in PLACES or b not in PLACES or a == b:
        return False
    (row_a, at_a), (row_b, at_b) = PLACES[a], PLACES[b]
    step, down = at_b - at_a, row_b - row_a
    return abs(step) == 1 if not down else abs(down) == 1 and step in ((-1, 0) if down > 0 else (0, 1))


def alphabet(value: str) -> int:
    classes = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for test, n in classes if any(map(test, value)))
    return size + (33 if not all(c.isalnum() for c in value) else 0)


def word_cost(piece: str, ranks: dict[str, int]) -> float | None:
    """Cost of a dictionary word, with capitals and look-alikes."""
    low = piece.lower()
    plain = low.translate(ALIKE)
    options = [(ranks.get(low), 0), (ranks.get(plain), sum(a != b for a, b in zip(low, plain))), (ranks.get(low[::-1]), 1)]
    costs = [log10(rank) + changed * log10(2) for rank, changed in options if rank]
    if not costs:
        return None
    capitals = sum(map(str.isupper, piece))
    shape = 0 if not capitals else 1 if capitals == len(piece) or (capitals == 1 and piece[0].isupper()) else capitals + 1
    return min(costs) + shape * log10(2)


def lowered(value: str) -> str:
    """Lower case, one character for each."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def walks(low: str) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, turns before each step) of each keyboard walk at its longest. Its parts are walks too."""
    start = 0
    while start < len(low) - 1:
        end, turns, was = start + 1, [0], None
        while end < len(low) and adjacent(low[end - 1], low[end]):
            step = (PLACES[low[end]][0] - PLACES[low[end - 1]][0], PLACES[low[end]][1] - PLACES[low[end - 1]][1])
            turns.append(turns[-1] + (was is not None and step != was))
            was = step
            end += 1
        if end - start >= LEAST_WALK:
            yield start, end, turns
        start = max(end - 1, start + 1)


def periodic_runs(low: str) -> list[tuple[int, int, int]]:
    """(unit, start, end) of every stretch that repeats a unit of any length twice or more, at its longest. A stretch
    that a divisor of its unit already repeats is left out: that one is always cheaper."""
    codes, out = np.array([ord(c) for c in low], np.uint32), []
    for unit in range(1, len(low) // 2 + 1):
        same = np.r_[False, codes[unit:] == codes[:-unit], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, upto in zip(edges[::2].tolist(), edges[1::2].tolist()):
            end = upto + unit
            if upto - start >= unit and not any(unit % u == 0 and s <= start and end <= e for u, s, e in out):
                out.append((unit, start, end))
    return out


def guess_cost(value: str, ranks: dict[str, int], longest: int | None = None) -> float:
    """The base-10 logarithm of the guesses for the cheapest cut of a value: the minimum over all cuts into dictionary
    words, dates, keyboard walks of ``LEAST_WALK`` keys or more, repeats of any unit (three characters or more), and
    single brute-force characters. ``longest`` is the length of the longest dictionary word."""
    n, low = len(value), lowered(value)
    longest = longest or max(map(len, ranks), default=0)
    char = log10(max(10, alphabet(value)))
    logs = np.log10(np.arange(1, n + 2))  # logs[i] is that of i + 1
    walked = {at: (start, end, np.array(turns)) for start, end, turns in walks(low) for at in range(start, end - LEAST_WALK + 1)}
    repeated: dict[int, list[tuple[int, int]]] = {}
    for unit, start, end in periodic_runs(low):
        for at in range(start, end - max(2 * unit, 3) + 1):
            repeated.setdefault(at, []).append((unit, end))
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    for at in range(n):
        so_far = best[at] + SEGMENT
        best[at + 1] = min(best[at + 1], best[at] + char)
        for end in range(at + 3, min(n, at + longest) + 1):
            cost = word_cost(value[at:end], ranks)
            if cost is not None:
                best[end] = min(best[end], so_far + cost)
        if value[at].isdigit():
            for end in {m.end() for form in DATES if (m := form.match(value, at))}:
                best[end] = min(best[end], so_far + log10(365 * 60 if end - at > 4 else 60))
        if at in walked:
            start, end, turns = walked[at]
            own = turns[at - start + LEAST_WALK - 1:] - turns[at - start + 1] + 1  # the first step sets a direction
            ends = best[at + LEAST_WALK:end + 1]
            np.minimum(ends, so_far + log10(len(PLACES)) + own * log10(6) + logs[LEAST_WALK - 1:end - at], out=ends)
        for unit, end in repeated.get(at, ()):
            least = 3 if unit == 1 else 2
            ends = best[at + least * unit:end + 1:unit]
            np.minimum(ends, so_far + unit * char + logs[least - 1:least - 1 + len(ends)], out=ends)
    return float(best[n])


def context_value(match: re.Match) -> tuple[str, float | None]:
    """The value of a ``CONTEXT`` match, and its cost where it only names a value. Punctuation after an unquoted value
    is not its own, nor is a bracket that was opened before it."""
    value, quoted = match[match.lastindex], match.lastindex < 3
    named = QUOTED_NAME.fullmatch(value) if quoted else BARE_NAME.fullmatch(value.rstrip(",;."))
    if quoted:
        return value, NAMED if named else None
    while value and (value[-1] in ".!?:,;\"'" or value[-1] in OPENERS and value.count(value[-1]) > value.count(OPENERS[value[-1]])):
        value = value[:-1]
    return value, NAMED if named else None


def spans_of(data: bytes | None, ranks: dict[str, int], strong: float = STRONG,
             longest: int | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) by start, then kind. Cheap byte searches decide which patterns are run at all."""
    if not data:
        return []
    hinted = any(h in (lower := data.lower()) for h in HINTS)
    keyed, hexed = b"AKIA" in data, b"x" * HEX_LEAST in data.translate(HEX_MARK)
    if not (hinted or keyed or hexed):
        return []
    del lower
    text, found = data.decode("utf-8", "replace"), []
    longest = longest or max(map(len, ranks), default=0)
    if hinted:
        found += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        for m in CONTEXT.finditer(text):
            value, cost = context_value(m)
            if len(value) < ASSIGN_LEAST:
                continue
            cost = guess_cost(value, ranks, longest) if cost is None else cost
            if cost >= strong:
                at = m.start(m.lastindex)
                found.append(("guess", at, at + len(value), cost))
    if keyed:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if hexed:
        found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("log10_guesses", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("log10_guesses", pa.float64())]))


def secret_spans(docs: DataFrame, words_file: str = WORDS_FILE, strong: float = STRONG) -> DataFrame:
    """One row per document: doc_id and all its spans."""
    words = read_words(words_file)
    longest, ranks = max(map(len, words), default=0), docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (v.as_buffer().to_pybytes() if v.is_valid else None for v in batch.column(1))
            spans = [[dict(zip(("kind", "start", "end", "log10_guesses"), s)) for s in spans_of(v, ranks.value, strong, longest)]
                     for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, T.StructType([docs.schema["doc_id"], T.StructField("spans", SPANS)]))
