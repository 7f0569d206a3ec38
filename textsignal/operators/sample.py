"""Samples, splits and folds that depend on row ids only, not on partition layout.

Rows are ordered by ``md5(seed:id)``; ids must be unique. To take the first k rows of
a class, only the key of its k-th row is looked up. The selection is then a filter on
literals: no class is sorted in one task, nothing is joined and no text is shuffled.

The lookups run small jobs when a function is called, over the id and class columns
only, so the input should be a stored table. Class counts and one key per cut reach
the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsignal.operators.profile import distribution

ROWS_PER_BUCKET = 100_000


def row_hash(seed: int, id_col: str = "comment_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _row_key(seed: int, id_col: str) -> Column:
    return F.struct(row_hash(seed, id_col).alias("hash"), F.col(id_col).cast("long").alias("id"))


def _class_sizes(df: DataFrame, by: str) -> dict:
    """Rows per class; one row per class reaches the driver."""
    return {row[by]: row["count"] for row in distribution(df, by).collect()}


def _keys_at(
    df: DataFrame, by: str, ranks: Mapping[object, Sequence[int]], largest: int, seed: int, id_col: str
) -> dict[tuple, Column]:
    """The row key at each wanted rank of each class, as literals.

    No class is ranked whole. A histogram over the first hash digits finds the bucket in
    which a rank lies, and only that bucket is ranked. The number of digits follows the
    class size, so buckets stay small.
    """
    wanted = [(value, rank) for value, all_ranks in ranks.items() for rank in all_ranks]
    if not wanted:
        return {}
    schema = T.StructType([df.schema[by], T.StructField("place", T.LongType())])
    places = F.broadcast(df.sparkSession.createDataFrame(wanted, schema)).withColumn("rank", F.col("place"))
    keyed = df.filter(F.col(by).isin(list(ranks))).select(by, _row_key(seed, id_col).alias("key"))
    keyed = keyed.select(by, "key.*")
    digits = 1
    while largest > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    keyed = keyed.withColumn("bucket", F.substring("hash", 1, digits))
    histogram = keyed.groupBy(by, "bucket").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(by).orderBy("bucket"))
    places = F.broadcast(  # a row for each wanted rank
        histogram.withColumn("before", upto - F.col("rows"))
        .join(places, by)
        .withColumn("place", F.col("rank") - F.col("before"))
        .filter(F.col("place").between(1, F.col("rows")))
        .select(by, "bucket", "place", "rank")
    )
    keyed = keyed.join(places.select(by, "bucket").distinct(), [by, "bucket"])
    order = Window.partitionBy(by, "bucket").orderBy("hash", "id")
    found = keyed.withColumn("place", F.row_number().over(order).cast("long")).join(places, [by, "bucket", "place"])
    return {
        (row[by], row["rank"]): F.struct(F.lit(row["hash"]), F.lit(row["id"]).cast("long"))
        for row in found.select(by, "rank", "hash", "id").collect()
    }


def _parts(
    df: DataFrame, by: str, sizes: Mapping[object, int], ends: Mapping[object, Sequence[int]],
    seed: int, id_col: str, value_of: Column | None = None,
) -> Column:
    """The chunk of its class's hash order a row falls in; ``ends`` are running ranks.

    ``value_of`` is the class as an expression, for a result that doesn't need the column ``by``.
    """
    of = F.col(by) if value_of is None else value_of
    inner = {v: sorted({e for e in es if 0 < e < sizes[v]}) for v, es in ends.items()}
    inner = {v: es for v, es in inner.items() if es}
    largest = max((sizes[v] for v in inner), default=0)
    keys = _keys_at(df, by, inner, largest, seed, id_col)
    key = _row_key(seed, id_col)
    part = F.lit(None).cast("int")
    for value, es in ends.items():
        chunk = F.lit(len(es))
        for i, end in reversed(list(enumerate(es))):
            if end >= sizes[value]:
                chunk = F.lit(i)
            elif end > 0:
                chunk = F.when(key <= keys[value, end], i).otherwise(chunk)
        part = F.when(of == value, chunk).otherwise(part)
    return part


def top_k_per_class(
    df: DataFrame, k: int, seed: int = 42, by: str = "label", id_col: str = "comment_id"
) -> DataFrame:
    """Up to ``k`` random rows of every class."""
    sizes = _class_sizes(df, by)
    return df.filter(_parts(df, by, sizes, {v: [min(k, n)] for v, n in sizes.items()}, seed, id_col) == 0)


def shuffled(df: DataFrame, seed: int, id_col: str = "comment_id") -> DataFrame:
    """Rows in random order, by a range sort on the row hash."""
    return df.orderBy(row_hash(seed, id_col), id_col)


def downsample(
    df: DataFrame, ratio: int = 3, seed: int = 42, label: str = "label", id_col: str = "comment_id"
) -> DataFrame:
    """All positives and at most ``ratio`` random negatives for each of them."""
    sizes = _class_sizes(df, label)
    kept = {v: [n if v == 1 else min(n, ratio * sizes.get(1, 0))] for v, n in sizes.items()}
    return df.filter(_parts(df, label, sizes, kept, seed, id_col) == 0)


def shares(sizes: Mapping[object, int], drawn: int) -> dict:
    """Rows per class when ``drawn`` are taken: largest remainder, ties in class order."""
    total = max(sum(sizes.values()), 1)
    taken = {v: n * drawn // total for v, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda v: (-(sizes[v] * drawn % total), v))
    for value in by_remainder[: drawn - sum(taken.values())]:
        taken[value] += 1
    return taken


def _quotas(sizes: Mapping[object, int], test: float, validation: float) -> tuple[dict, dict]:
    """Rows per class of the test part, and of the validation part of the rest."""
    n_test = shares(sizes, ceil(sum(sizes.values()) * test))
    left = {v: n - n_test[v] for v, n in sizes.items()}
    return n_test, shares(left, ceil(sum(left.values()) * validation))


def stratified(
    df: DataFrame, test: float = 0.2, validation: float | None = None, seed: int = 42,
    label: str = "label", id_col: str = "comment_id",
) -> DataFrame:
    """Add ``split``: random ``test``, then ``validation`` from the rest, then ``train``.

    Every class keeps its share. Where a class has a single row the split is plain random.
    """
    sizes = _class_sizes(df, label)
    by, rows = label, df
    if min(sizes.values(), default=0) < 2:
        by, rows = "_all", df.withColumn("_all", F.lit(0))
        sizes = {0: sum(sizes.values())}
    n_test, n_validation = _quotas(sizes, test, validation or 0)
    ends = {v: [n_test[v], n_test[v] + n_validation[v]] for v in sizes}
    part = _parts(rows, by, sizes, ends, seed, id_col)
    split = F.element_at(F.array(*map(F.lit, ("test", "validation", "train"))), part + 1)
    return rows.withColumn("split", split).select(*df.columns, "split")


def _fold_ends(n: int, m: int) -> list[int]:
    """Where all folds but the last end among m rows."""
    return [(i + 1) * (m // n) + min(i + 1, m % n) for i in range(n - 1)]


def binary_split(
    df: DataFrame, test: float = 0.2, validation: float = 0.2, ratio: int = 3, n_folds: int = 3, seed: int = 42,
    label: str = "label", id_col: str = "comment_id",
) -> DataFrame:
    """Add ``split`` and ``fold``: what ``stratified``, ``downsample`` of its training part and ``folds`` of the rest give in turn.

    All of them take a class's rows in one hash order, so each part is a stretch of it: one job counts
    the classes, one looks up the keys at all cuts. ``fold`` is null for rows that no fit uses.
    """
    sizes = _class_sizes(df, label)
    if min(sizes.values(), default=0) < 2:
        split = stratified(df, test, validation, seed, label, id_col)
        kept = folds(downsample(split.filter("split = 'train'"), ratio, seed, label, id_col), n_folds, seed, label, id_col)
        return split.join(kept.select(id_col, "fold"), id_col, "left").select(*split.columns, "fold")
    n_test, n_validation = _quotas(sizes, test, validation)
    left = {v: n - n_test[v] - n_validation[v] for v, n in sizes.items()}
    ends = {}
    for v in sizes:
        kept = left[v] if v == 1 else min(left[v], ratio * left.get(1, 0))
        first = n_test[v] + n_validation[v]
        ends[v] = [n_test[v], first, *(first + e for e in _fold_ends(n_folds, kept)), first + kept]
    part = _parts(df, label, sizes, ends, seed, id_col)
    names = ("test", "validation", *["train"] * (n_folds + 1))
    rows = df.withColumn("_part", part)
    split = F.element_at(F.array(*map(F.lit, names)), F.col("_part") + 1)
    fold = F.when(F.col("_part").between(2, n_folds + 1), F.col("_part") - 2)
    return rows.select(*df.columns, split.alias("split"), fold.alias("fold"))


def _period() -> Column:
    return F.col("yyyy") * 100 + F.col("mm")


@dataclass(frozen=True)
class TemporalCut:
    """A cut in time: rows of months before it are early, those of the month it falls in by their place in hash order."""

    is_early: Column
    last_early: int | None  # month of the last early rows
    first_late: int | None

    def split(self, df: DataFrame) -> DataFrame:
        """Add ``split``: ``train`` or ``test``."""
        return df.withColumn("split", F.when(self.is_early, "train").otherwise("test"))

    def early(self, df: DataFrame) -> DataFrame:
        """The early rows; of a table stored by month, other months aren't read."""
        return df.filter(F.lit(False) if self.last_early is None else (_period() <= self.last_early) & self.is_early)

    def late(self, df: DataFrame) -> DataFrame:
        return df.filter(F.lit(False) if self.first_late is None else (_period() >= self.first_late) & ~self.is_early)


def temporal_cut(df: DataFrame, fraction: float = 0.7, seed: int = 42, id_col: str = "comment_id") -> TemporalCut:
    """Where the first ``int(fraction * n)`` rows by year and month end; only one month is divided, in hash order."""
    rows = df.withColumn("_period", _period())
    sizes = _class_sizes(rows, "_period")
    left, whole, divided = floor(sum(sizes.values()) * fraction), [], {}
    for period in sorted(sizes):
        if sizes[period] <= left:
            whole.append(period)
        elif left > 0:
            divided[period] = [left]
        left = max(left - sizes[period], 0)
    part = _parts(rows, "_period", sizes, divided, seed, id_col, _period())
    last_whole = max(whole, default=None)
    first = min(divided, default=min((p for p in sizes if last_whole is None or p > last_whole), default=None))
    early = F.coalesce(part == 0, _period() <= last_whole, F.lit(False))
    return TemporalCut(early, max(divided, default=last_whole), first)


def temporal(
    df: DataFrame, fraction: float = 0.7, seed: int = 42, id_col: str = "comment_id"
) -> DataFrame:
    """Add ``split``: the first ``int(fraction * n)`` rows by year and month are ``train``."""
    return temporal_cut(df, fraction, seed, id_col).split(df)


def folds(
    df: DataFrame, n: int = 3, seed: int = 42, label: str = "label", id_col: str = "comment_id",
    name: str = "fold",
) -> DataFrame:
    """Add a random fold number; in every class fold sizes differ by at most one row."""
    sizes = _class_sizes(df, label)
    ends = {v: _fold_ends(n, m) for v, m in sizes.items()}
    return df.withColumn(name, _parts(df, label, sizes, ends, seed, id_col))


def allows_validation(
    df: DataFrame, min_rows: int = 50, min_positives: int = 5, label: str = "label"
) -> bool:
    """True when a training part is large enough to carve a validation part from."""
    sizes = _class_sizes(df, label)
    return sum(sizes.values()) > min_rows and sizes.get(1, 0) >= min_positives


def inner_validation(
    df: DataFrame, share: float = 0.2, seed: int = 42, label: str = "label", id_col: str = "comment_id"
) -> DataFrame:
    """Add ``split``: ``validation`` carved from ``df`` where it is large enough, else all ``train``."""
    if not allows_validation(df, label=label):
        return df.withColumn("split", F.lit("train"))
    parts = stratified(df, share, None, seed, label, id_col)
    return parts.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))
