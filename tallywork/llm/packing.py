"""Blocks of rows and packed arrays, as the Python stages exchange them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 12 << 20  # text of one block; bounds the memory of a Python worker


def pack(values, dtype) -> bytes:
    """An array as compressed bytes."""
    return zstandard.compress(np.ascontiguousarray(values, dtype=dtype).tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=dtype)


def pack_text(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def unpack_text(data: bytes) -> bytes:
    return zstandard.decompress(data)


def text_blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """Splits a partition into blocks of about ``limit`` bytes: (rows of the other columns as tuples, texts as bytes).
    NULL texts are empty. A text over the limit is a block of its own with what came before it."""
    rows, texts, held = [], [], 0
    for batch in batches:
        others = [batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != text]
        column = batch.column(batch.schema.names.index(text))
        for at, value in enumerate(column):
            data = value.as_buffer().to_pybytes() if value.is_valid else b""
            rows.append(tuple(c[at] for c in others))
            texts.append(data)
            held += len(data)
            if held >= limit:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs, with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ..., start + length - 1 of each run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return first + np.arange(total)
