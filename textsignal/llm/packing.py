"""Packing token sequences into fixed windows by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsignal.llm import bytebpe
from textsignal.llm.common import pick, slices
from textsignal.sources.tables import cut_lineage

WINDOW = 1024
END = 0  # the id behind each document
LADDER = 16  # middle lengths tried for each shortest length of a combination of three
PASSES = 60  # of the solver
RANKED = 4096  # pieces of one length that are numbered together


def combinations(lengths: list[int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Combinations of two and three of the lengths that fill the window; the middle one of three is taken in even steps."""
    have, out = set(lengths), []
    for i in sorted(have):
        if 2 * i <= window and window - i in have:
            out.append((window - i, i))
    for i in sorted(have):
        middle = [j for j in range(i, (window - i) // 2 + 1) if j in have and window - i - j in have]
        step = max(1, len(middle) // LADDER)
        out += [(window - i - j, j, i) for j in middle[::step]]
    return out


def solve(columns: list[tuple[int, ...]], histogram: dict[int, int], passes: int = PASSES) -> list[float]:
    """Repeat counts x >= 0 that minimise the squared misfit between combinations used and the histogram.

    Coordinate descent: each combination in turn goes to its best non-negative count given
    the others. The misfit never grows, and a pass without a move of 0.01 ends the search.
    """
    left = dict.fromkeys({n for c in columns for n in c}, 0.0) | {n: float(k) for n, k in histogram.items()}
    parts = [tuple((n, c.count(n)) for n in dict.fromkeys(c)) for c in columns]
    x = [0.0] * len(columns)
    for _ in range(passes):
        moved = 0.0
        for j, part in enumerate(parts):
            step = sum(left[n] * k for n, k in part) / sum(k * k for _, k in part)
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in part:
                    left[n] -= k * step
        if moved < 0.01:
            break
    return x


def recipes(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with repeat counts that use up the histogram exactly.

    Whole windows stand alone. The solved counts are rounded and cut to what is left; the
    rest is packed greedily: the longest length first, filled with the longest that fits, as
    many times as the counts allow.
    """
    left = {n: k for n, k in sorted(histogram.items()) if k > 0}
    out = [((window,), left.pop(window))] if window in left else []
    columns = combinations(list(left), window)
    found = solve(columns, left)
    for j in sorted(range(len(columns)), key=lambda j: -found[j]):
        column = columns[j]
        times = min([round(found[j]), *(left[n] // column.count(n) for n in set(column))])
        if times > 0:
            out.append((column, times))
            for n in column:
                left[n] -= times
    lengths = sorted(n for n, k in left.items() if k)
    while lengths:
        used: dict[int, int] = {}
        taken, room = [], window
        while room:
            at = bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
                at -= 1
            if at < 0:
                break
            n = lengths[at]
            taken.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        times = min(left[n] // k for n, k in used.items())
        out.append((tuple(taken), times))
        for n, k in used.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return out


def _slots(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank) with first sequence and offset: where a length's ranked pieces go."""
    rows, ranks, first = [], {}, 0
    for column, times in made:
        offset = 0
        for n in column:
            rank = ranks.get(n, 0)
            rows.append((n << 44 | rank, first, offset))
            ranks[n] = rank + times
            offset += n
        first += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], [])))


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of at most a window: ``doc_id, start, length, ids_crc32, doc_tokens``."""

    def run(batches):
        for b in slices(batches):
            rows = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for key, ids in zip(b.column("doc_id").to_pylist(), bytebpe.encode(texts, tokenizer)):
                whole = np.append(ids, np.uint32(END)).astype("<u4")
                for start in range(0, len(whole), window):
                    piece = whole[start:start + window]
                    rows.append((key, start, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and one end id, cut into pieces and packed into sequences of at most a window.

    A document gives whole windows and one rest. The rests' histogram, at most ``window`` rows, goes to
    the driver, which solves for repeat counts of combinations that fill a window. Pieces of a length are
    numbered, in groups of about ``RANKED`` so that a common length is spread, and the number
    names sequence and offset. Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    Null text: the end id alone. Repeated rows and ids: each row is packed by itself. Null id: kept.
    Empty table: no rows. Other columns are ignored. ``tokenizer`` is a file on every machine.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    pieces = cut_lineage(cut(rows, tokenizer, window).withColumn("place", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    keys, first, offset = _slots(recipes(histogram, window))
    buckets = max(1, sum(histogram.values()) // RANKED)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("place")) - 1
    ranked = dealt.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + rank).drop("before", "bucket", "place")

    def place(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c), np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            sequence = first[at] + rank - (keys[at] & ((1 << 44) - 1)) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence), pa.array(offset[at] if len(at) else at)],
                [*names, "sequence_id", "offset"],
            )

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return ranked.select(*names, "rank").mapInArrow(
        place, ", ".join(f"{c} long" for c in (*names, "sequence_id", "offset"))
    )
