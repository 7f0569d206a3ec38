"""Hard negatives by score windows: Hilbert-ordered candidate blocks, zone maps and interval bounds choose what is read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.llm.common import pick
from textsignal.llm.topk import weights
from textsignal.sources.tables import cut_lineage

ROWS = 1024  # candidates of a block
ANCHORS = 1024  # anchors of a sheet
ZONES = 1024  # blocks whose zone maps are compared with a sheet of anchors at once
AXES, BITS = 8, 7  # of the Hilbert curve
_UP = 1 << 62  # more than any score


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point along the Hilbert curve through a grid of ``2**bits`` cells an axis; axes times bits is 63 at most.

    From the highest bit down, each axis' bit tells how the lower bits of the first axis are turned: inverted, or
    exchanged with those of that axis. What is left is a Gray code, which is undone and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            there = (x[i] & q) > 0
            turned = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(there, x[0] ^ low, x[0] ^ turned)
            x[i] = x[i] ^ turned if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; a shorter vector has zeros behind its end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dims), np.int64)
    if len(column):
        length = np.asarray(column.value_lengths(), np.int64)
        row = np.repeat(np.arange(len(length)), length)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = np.asarray(column.flatten(), np.int64)
    return out


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with any vector in each box, by interval arithmetic."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles, where none can reach 2**53, else as integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with any vector of each box, by interval arithmetic."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(plus, low) + product(minus, high), product(plus, high) + product(minus, low)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(c).combine_chunks(), np.int64) for c in names]


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {more} long"


def curve(rows: DataFrame, dims: int) -> DataFrame:
    """The rows with ``place``, that of the vector along the Hilbert curve.

    An axis is a sum of the vector's components with signs from a fixed generator; cells are cut
    between four standard deviations on both sides of its mean, and outer ones are wider.
    """
    signs = np.random.default_rng(0).choice([-1.0, 1.0], (dims, AXES))
    names = rows.columns

    def moments(batches):
        for b in batches:
            axes = matrix(b.column("w"), dims) @ signs
            sums = np.concatenate([[b.num_rows], axes.sum(0), (axes * axes).sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], [f"m{i}" for i in range(len(sums))])

    parts = rows.mapInArrow(moments, ", ".join(f"m{i} double" for i in range(2 * AXES + 1)))
    n, *found = (m or 0.0 for m in parts.agg(*[F.sum(c) for c in parts.columns]).first())
    mean, square = np.array(found).reshape(2, AXES) / max(n, 1)
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    low, wide = mean - 4 * spread, np.where(spread > 0, 8 * spread, 1.0)

    def run(batches):
        for b in batches:
            axes = matrix(b.column("w"), dims) @ signs
            cell = np.clip((axes - low) / wide * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cell, BITS))], [*names, "place"])

    return rows.mapInArrow(run, _schema(rows, "place"))


def blocked(rows: DataFrame, n: int, size: int, number: str) -> DataFrame:
    """The rows in the order of the curve as Parquet, numbered in blocks of ``size`` rows.

    Ranges of the curve are sorted each for itself. Rows in each range, a number for each of Spark's partitions, give every
    range its first place; so blocks are full, however many ranges there are.
    """
    kept = rows.columns

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            places = seen + np.arange(b.num_rows)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(places)], [*kept, "part", "at"])

    # equal vectors are dealt by id, and equal rows by where they stand
    keys = ["place", "vec_id", F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(max(1, -(-n // (16 * size))), *keys).sortWithinPartitions("place", "vec_id")
    ranges = cut_lineage(ordered.mapInArrow(run, _schema(rows, "part long, at")), f"{number}-ranges")
    counts = dict(ranges.groupBy("part").count().collect())
    firsts, first = [], 0
    for part in sorted(counts):
        firsts.append((part, first))
        first += counts[part]
    begins = rows.sparkSession.createDataFrame(firsts, "part long, first long")
    return ranges.join(F.broadcast(begins), "part").select(*kept, F.expr(f"(first + at) div {size}").alias(number))


ZONE = "block long, low array<long>, high array<long>, label_low long, label_high long"


def zone_maps(blocks: DataFrame, dims: int) -> DataFrame:
    """Least and largest weight of each dimension, and label, in each block; made where rows are read, and merged."""

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * dims, pa.int32()), pa.array(values.astype(np.int64).ravel()))

    def extremes(block, low, high, label_low, label_high) -> list[pa.Array]:
        order = np.argsort(block, kind="stable")
        met, first = np.unique(block[order], return_index=True)
        least, most = np.minimum.reduceat, np.maximum.reduceat
        return [
            pa.array(met), lists(least(low[order], first, axis=0)), lists(most(high[order], first, axis=0)),
            pa.array(least(label_low[order], first)), pa.array(most(label_high[order], first)),
        ]

    names = ["block", "low", "high", "label_low", "label_high"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                block, label = (np.asarray(b.column(c), np.int64) for c in ("block", "label"))
                w = matrix(b.column("w"), dims)
                yield pa.RecordBatch.from_arrays(extremes(block, w, w, label, label), names)

    def merge(rows: pa.Table) -> pa.Table:
        block, *labels = _numbers(rows, "block", "label_low", "label_high")
        return pa.table(extremes(block, *(matrix(rows.column(c), dims) for c in ("low", "high")), *labels), names)

    parts = blocks.select("block", "label", "w").mapInArrow(run, ZONE)
    return cut_lineage(parts.groupBy("block").applyInArrow(merge, ZONE), "zones")


def _first(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Of the places, those of the k highest scores, ties to the smaller id."""
    if len(places) > k:
        least = -np.partition(-scores[places], k - 1)[k - 1]
        places = places[scores[places] >= least]
    return places[np.lexsort((ids[places], -scores[places]))][:k]


class Search:
    """Blocks of candidates with zone maps, and sheets of anchors. A search reads, for each sheet, chosen blocks only."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks, dims
        zones = zone_maps(blocks, dims)
        self.groups = max(1, -(-zones.count() // ZONES))
        self.zones = zones.withColumn("zone", F.pmod(F.xxhash64("block"), F.lit(self.groups)).cast("int"))

    def bounded(self, anchors: DataFrame, run, schema: str) -> DataFrame:
        """What ``run`` makes of a sheet's anchors, and the least and largest scores that each block of a group of zone maps lets them have."""
        dims = self.dims

        def both(anchors: pa.Table, zones: pa.Table) -> pa.Table:
            box = (matrix(zones.column(c), dims) for c in ("low", "high"))
            return run(anchors, zones, *bounds(matrix(anchors.column("w"), dims), *box))

        asked = anchors.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        met = asked.select(*[F.col(c).alias(c) for c in ("sheet", "zone")]).distinct()
        zones = self.zones.join(met, "zone")
        return asked.groupBy("sheet", "zone").cogroup(zones.groupBy("sheet", "zone")).applyInArrow(both, schema)

    def scored(self, anchors: DataFrame, reads: DataFrame, run, schema: str) -> DataFrame:
        """What ``run`` makes of a sheet's anchors, the rows of a block that it reads, and their scores."""
        dims = self.dims

        def both(anchors: pa.Table, rows: pa.Table) -> pa.Table:
            return run(anchors, rows, product(matrix(anchors.column("w"), dims), matrix(rows.column("w"), dims)))

        read = reads.select(*[F.col(c).alias(c) for c in ("sheet", "block")])
        rows = self.blocks.select("vec_id", "label", "w", "block").join(read, "block")
        return anchors.join(reads, "sheet").groupBy("sheet", "block").cogroup(rows.groupBy("sheet", "block")).applyInArrow(both, schema)


def _rows(names: list[str], made: list[tuple]) -> pa.Table:
    """A table of parts of columns; a number stands for as many as the part has rows."""
    wide = [max((len(c) for c in part if np.ndim(c)), default=0) for part in made]
    return pa.table({
        name: pa.array(np.concatenate([np.zeros(0, np.int64), *(np.broadcast_to(part[i], n) for part, n in zip(made, wide))]).astype(np.int64))
        for i, name in enumerate(names)
    })


def peaks(per_anchor: int):
    """The blocks of the highest bounds that can have rows of the anchor's label."""

    def run(anchors, zones, _, high):
        label, low_label, high_label, block = _numbers(anchors, "label")[0], *_numbers(zones, "label_low", "label_high", "block")
        ids, asked = _numbers(anchors, "vec_id", "asked")
        out = []
        for i in range(len(label)):
            there = np.flatnonzero((low_label <= label[i]) & (label[i] <= high_label))
            best = _first(high[i], block, there, per_anchor)
            out.append((ids[i], asked[i], block[best], high[i][best]))
        return _rows(["vec_id", "asked", "block", "bound"], out)

    return run


def _reads(needed) -> tuple:
    """Blocks that any anchor of the sheet needs."""

    def run(anchors, zones, low, high):
        need = needed(anchors, low, high, *_numbers(zones, "label_low", "label_high"))
        block = _numbers(zones, "block")[0][need.any(0)]
        sheet = _numbers(anchors, "sheet")[0][:1]
        return _rows(["sheet", "block"], [(sheet[0], block)] if len(sheet) else [])

    return run, "sheet long, block long"


def positives(k: int):
    """The first k other rows of the anchor's label in a block."""

    def run(anchors, rows, scores):
        label, ids, asked = _numbers(anchors, "label", "vec_id", "asked")
        other, of = _numbers(rows, "label", "vec_id")
        out = []
        for i in range(len(ids)):
            best = _first(scores[i], of, np.flatnonzero((other == label[i]) & (of != ids[i])), k)
            out.append((ids[i], asked[i], of[best], scores[i][best]))
        return _rows(["vec_id", "asked", "positive_id", "positive_score"], out)

    return run, "vec_id long, asked long, positive_id long, positive_score long"


def negatives(k: int, least: int, most: int):
    """The first k rows of other labels in a block whose score lies in each window, in percent of a positive's score."""

    def run(anchors, rows, scores):
        label, ids, asked = _numbers(anchors, "label", "vec_id", "asked")
        other, of = _numbers(rows, "label", "vec_id")
        out = []
        for i, tops in enumerate(anchors.column("tops").to_pylist()):
            strange = np.flatnonzero((other != label[i]) & (of != ids[i]))
            percent = 100 * scores[i][strange]
            for rank, top in enumerate(tops):
                best = _first(scores[i], of, strange[(percent >= least * top) & (percent <= most * top)], k)
                if len(best):
                    out.append((ids[i], asked[i], rank + 1, of[best], scores[i][best]))
        return _rows(["vec_id", "asked", "place", "negative_id", "negative_score"], out)

    return run, "vec_id long, asked long, place long, negative_id long, negative_score long"


def _top(df: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, *, n_positives: int = 5, n_negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256,
    label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` an expression on ``vec_id`` and ``label`` that replaces
    the label. Components become floor(scale * x); a score is the inner product with the anchor; higher ones come first, ties
    by smaller id. For each anchor and each of its first ``n_positives`` other rows of its label, the
    first ``n_negatives`` rows of other labels whose score is ``least`` to ``most`` percent of the positive's.

    Candidates are ordered along a Hilbert curve and written as blocks of ``ROWS`` rows with a zone map: least
    and largest weight by dimension. Bounds by interval arithmetic choose the blocks that a sheet of anchors reads: first
    two that promise most, whose scores give a floor; then those that can beat the floor, for exact
    positives; then those that can have scores in a window. No block is left out that its bounds don't rule out.

    Null ids, labels or vectors and null or non-finite components take no part. Missing dimensions of a
    shorter vector count as 0. Rows of the anchor's id are not its others. Equal rows are candidates each for itself
    and one anchor; rows that share an id but differ are anchors of their own. Empty table: no rows.
    """
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), weights(F.col("vector"), scale).alias("w")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND w IS NOT NULL")
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    rows = cut_lineage(rows, "weights")
    n, dims = rows.agg(F.count("*"), F.max(F.size("w"))).first()
    dims = dims or 0
    placed = cut_lineage(curve(rows, dims), "curve")
    search = Search(blocked(placed, n, ROWS, "block"), dims)
    asking = placed.filter(is_anchor).distinct().withColumn("asked", F.xxhash64("label", "w"))
    anchors = cut_lineage(blocked(asking, asking.count(), ANCHORS, "sheet").drop("place"), "anchors")
    own = ["vec_id", "asked"]

    seeds = _top(search.bounded(anchors, peaks(2), "vec_id long, asked long, block long, bound long"), own, "bound", "block", 2, "at")
    reads = cut_lineage(seeds.join(anchors.select(*own, "sheet"), own).select("sheet", "block").distinct(), "seeds")
    seen = search.scored(anchors, reads, *positives(n_positives))
    floors = _top(seen, own, "positive_score", "positive_id", n_positives, "at").filter(F.col("at") == n_positives)
    floors = cut_lineage(anchors.join(floors.select(*own, F.col("positive_score").alias("floor")), own, "left")
                         .withColumn("floor", F.coalesce("floor", F.lit(-_UP))), "floors")

    def beats(anchors, low, high, label_low, label_high):
        label, floor = _numbers(anchors, "label", "floor")
        return (high >= floor[:, None]) & (label_low <= label[:, None]) & (label[:, None] <= label_high)

    reads = cut_lineage(search.bounded(floors, *_reads(beats)), "reads")
    found = _top(search.scored(anchors, reads, *positives(n_positives)), own, "positive_score", "positive_id", n_positives, "place")
    found = cut_lineage(found, "positives")
    tops = found.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda t: t["positive_score"]).alias("tops"))
    windows = cut_lineage(anchors.join(tops, own), "windows")

    def meets(anchors, low, high, label_low, label_high):
        label = _numbers(anchors, "label")[0]
        need = np.zeros(low.shape, bool)
        for i, tops in enumerate(anchors.column("tops").to_pylist()):
            for top in (t for t in tops if least * t <= most * t):
                need[i] |= (100 * high[i] >= least * top) & (100 * low[i] <= most * top)
        return need & ~((label_low == label[:, None]) & (label_high == label[:, None]))

    reads = cut_lineage(search.bounded(windows, *_reads(meets)), "reads")
    hard = search.scored(windows, reads, *negatives(n_negatives, least, most))
    hard = _top(hard, [*own, "place"], "negative_score", "negative_id", n_negatives, "rank")
    return hard.join(found, [*own, "place"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )


ORACLE_SQL = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
    CAST(list_sum([a.w[i] * c.w[i] FOR i IN range(1, len(a.w) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
