"""Helpers shared by the operators: column choice, Arrow texts as byte arrays, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 19  # bytes of text worked on at once: the arrays stay in the processor's cache
_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under new names.

    Columns are found by position, so other columns may have any names, also names that
    differ in case only or occur twice; an exact match goes before one that ignores case.
    """
    found = {}
    for new, old in names.items():
        exact = [i for i, c in enumerate(df.columns) if c == old]
        found[new] = (exact or [i for i, c in enumerate(df.columns) if c.lower() == old.lower()])[0]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in found.items()])


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns renamed by position, and the first position of each name."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain, {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 places where they start and end. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = pc.fill_null(texts, b"" if kind == pa.large_binary() else "").cast(kind)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that few texts are Python objects at a time."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is alone in its range."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = high


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, n at least, of the base modulo 2**64, and their inverses."""
    size = 1 << max(n, CHUNK).bit_length()
    if size not in _tables:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > 2 * CHUNK:
            return made[0], made[1]
        _tables[size] = (made[0], made[1])
    return _tables[size]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power, from which ``spans`` takes the hash of any span."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][:len(data)], out=total[1:])
    return total


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    h = (total[end] - total[start]) * powers(len(total))[1][start]
    return mix(h ^ (end - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: a run of bytes other than ASCII white space."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = at[:-1], at[1:] - 1
    begins, ends = begins[begins < at[1:]], ends[ends >= at[:-1]]
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


def hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the n + 1 places where the texts' words start and end."""
    start, end, doc = words(data, at)
    return spans(running(data), start, end), np.searchsorted(doc, np.arange(len(at)))
