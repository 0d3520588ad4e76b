"""Line-first cleaning: every line is judged alone, failing lines go, and a document that loses too much text goes.

Line rules (a line without words always stays):

* punctuation: the line must end with terminal punctuation, closing quotes and brackets aside; not so a paragraph, which is
  a line of over ``PARAGRAPH`` code points;
* navigation: a line with three or more separators between items, and one a hundred code points, is a menu or a table row;
* symbols: a line in which over a tenth of the characters are symbols is markup or noise;
* shouting: a line of five or more letters without a lower-case one;
* boilerplate: licence, cookie, script, login and sharing phrases, as a fixed list of English ones. Of a paragraph only the
  sentences with such a phrase go.

Document rules come before (fewer than 50 words; over half of the words in repeated three-word windows) and after
(``LOST`` of the word characters were in removed lines and sentences). Repeated lines are only counted.

Defined cases: a NULL text has no words and is rejected. An empty table gives an empty result. Each row is judged alone,
so repeated rows get equal verdicts. A text of any length is judged whole. Other columns, whatever their names, pass through ``cleaned`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS, REPEATED_PERCENT, PARAGRAPH, SEPARATOR_CHARS = 50, 50, 400, 100
LOST, SEPARATORS, SYMBOL_SHARE, SHOUTED_LETTERS = 0.3, 3, 0.1, 5
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
CLOSING, TERMINAL = "\"')]}”’»", tuple(".!?:;…。！？؟।")
SEPARATOR, SEPARATOR_MARKS = re.compile(r"[|¦»•·]| [>/] "), (*"|¦»•·", " > ", " / ")
SENTENCE = re.compile(r"[^.!?…。！？؟।]*[.!?…。！？؟।]*")
# Phrases of web boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "we use cookies", "accept cookies", "accept all cookies", "enable javascript", "click here", "sign in to", "log in to",
    "subscribe now", "subscribe to our", "copyright (c)", "copyright ©", "lorem ipsum", "skip to content",
    "skip to main content", "share this", "read more")

VERDICT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_lines", T.LongType()), T.StructField("n_removed_lines", T.LongType()),
    T.StructField("kept", T.BooleanType())])


def boilerplate(text: str) -> bool:
    low = text.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def separated(line: str) -> bool:
    """Whether a line has ``SEPARATORS`` separators or more, and one a ``SEPARATOR_CHARS`` code points."""
    least = max(SEPARATORS, len(line) / SEPARATOR_CHARS)
    if sum(map(line.count, SEPARATOR_MARKS)) < least:  # never fewer than the pattern finds
        return False
    return len(SEPARATOR.findall(line)) >= least


def line_fails(line: str) -> bool:
    """For a line with words, without white space at its ends."""
    paragraph = len(line) > PARAGRAPH
    if not paragraph and not line.rstrip(CLOSING).endswith(TERMINAL):
        return True
    if sum(map(line.count, SYMBOLS)) > SYMBOL_SHARE * len(line) or separated(line):
        return True
    if line.isupper() and sum(map(str.isalpha, line)) >= SHOUTED_LETTERS:
        return True
    return not paragraph and boilerplate(line)


def sentences_left(line: str) -> str:
    """A paragraph without its sentences of boilerplate."""
    if not boilerplate(line):
        return line
    return "".join(s for s in SENTENCE.findall(line) if not boilerplate(s)).strip(SPACE)


def word_characters(text: str) -> int:
    return len(text) - sum(map(text.count, SPACE))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0
    pairs, base = number[:-1] * len(known) + number[1:], len(known)
    if base >= 1 << 21:  # three numbers would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].ravel()
    windows = pairs[:-1] * base + number[2:]
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(windows)] |= again
    return int(covered.sum())


def judge(data: bytes | None) -> tuple[tuple, str]:
    """The values of ``VERDICT`` for a UTF-8 text, and the text without its failing lines."""
    data = data or b""
    text, words = data.decode("utf-8", "replace"), data.split()
    word_chars = word_characters(text)
    symbols = sum(map(text.count, SYMBOLS))
    seen, stays, repeats, lost, removed = set(), [], 0, 0, 0
    lines = text.split("\n")
    for line in lines:
        core = line.strip(SPACE)
        if core:
            repeats += line in seen
            seen.add(line)
            if line_fails(core):
                lost, removed = lost + word_characters(core), removed + 1
                continue
            if len(core) > PARAGRAPH and (left := sentences_left(core)) is not core:
                lost += word_characters(core) - word_characters(left)
                line = left
        stays.append(line)
    again = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * again > REPEATED_PERCENT * len(words)
    kept = not failed and lost <= LOST * word_chars
    return (len(words), word_chars, symbols, repeats, again, failed, len(lines), removed, kept), \
        "\n".join(stays)


def _values(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    for value in batch.column(batch.schema.names.index(column)):
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            columns = zip(*(judge(t)[0] for t in _values(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *VERDICT.names])


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the columns of ``VERDICT``. The texts stay where they are."""
    out = T.StructType([docs.schema["doc_id"], *VERDICT.fields])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_judge_batches, out)


def _clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the rows whose document stays. The columns are ``text``, ``n_chars`` and whatever else there is."""
    for batch in batches:
        found = [judge(t) for t in _values(batch, "_text")]
        stays = [at for at, (verdict, _) in enumerate(found) if verdict[-1]]
        left = batch.take(pa.array(stays, pa.int64())).drop_columns(["_text"])
        texts = [found[at][1] for at in stays]
        yield pa.RecordBatch.from_arrays([*left.columns, pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], [*left.schema.names, "_text", "_chars"])


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents with their own columns. ``text`` has lost its failing lines, and ``n_chars`` follows it."""
    own = {c: f"_{at}" for at, c in enumerate(docs.columns) if c not in ("text", "n_chars")}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], F.col("text").cast("binary").alias("_text"))
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("_text", T.StringType()),
                        T.StructField("_chars", T.LongType())])
    kept = rows.mapInArrow(_clean_batches, out)
    new = {"text": F.col("_text"), "n_chars": F.col("_chars").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col(own.get(c, "_text"))).alias(c) for c in docs.columns])
