"""Metrics, curves and thresholds over a table of labels and scores.

Counts come first: rows are pre-aggregated per score or per pair of classes, so one
score or class that holds most rows is one row afterwards. Functions of scores take rows or
their ``score_table``, functions of predictions take rows or their ``confusion``, so that
one read of the rows serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions.lexicon import INTENSITY_NAMES
from textsignal.sources.tables import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def score_table(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Running counts per different score, as a stored table.

    Columns: ``score, pos, neg`` at the score, ``tp, fp`` at or above it, the totals
    ``n_pos, n_neg``, and ``next_pos, next_neg`` at the next lower score (null at the last).
    Null scores are left out; NaN is an error. A score table is returned as it is.

    The counts are dealt to partitions by ranges of the score. Ranges are summed, the range sums, one for
    each partition, are accumulated, and each range is accumulated on its own.
    """
    if {"tp", "fp", "next_pos"} <= set(df.columns):
        return df
    value = F.col(score).cast("double")
    sound = F.when(F.isnan(value), F.raise_error(F.lit("a score is NaN")).cast("double")).otherwise(value)
    counts = df.filter(value.isNotNull()).groupBy(sound.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    parts = cut_lineage(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")

    high_first = Window.orderBy(F.col("part").desc())
    upto, everything = high_first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = parts.groupBy("part").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"),
        F.max_by(F.struct("pos", "neg"), "score").alias("top"),
    )
    ranges = totals.select(
        "part",
        F.coalesce(F.sum("p").over(upto), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("q").over(upto), F.lit(0)).alias("fp_above"),
        F.sum("p").over(everything).alias("n_pos"),
        F.sum("q").over(everything).alias("n_neg"),
        F.lead("top").over(high_first).alias("next_top"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("score").desc())
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return cut_lineage(parts.join(F.broadcast(ranges), "part").select(
        "score", "pos", "neg",
        (F.col("tp_above") + F.sum("pos").over(running)).alias("tp"),
        (F.col("fp_above") + F.sum("neg").over(running)).alias("fp"),
        "n_pos", "n_neg",
        F.coalesce(F.lead("pos").over(inside), F.col("next_top.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inside), F.col("next_top.neg")).alias("next_neg"),
    ), "score-table")


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``roc_auc`` by the rank sum, ties counted half; null with a single class or without scores."""
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return score_table(df, label, score).agg(
        F.try_divide(F.sum(wins), F.max("n_pos").cast("double") * F.max("n_neg")).alias("roc_auc")
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``threshold, fpr, tpr``: corner points only, and the start at (0, 0) with threshold infinity."""
    def point(threshold: Column, fpr: Column, tpr: Column) -> Column:
        return F.struct(threshold.alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))

    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    own = point(F.col("score"), F.try_divide("fp", "n_neg"), F.try_divide("tp", "n_pos"))
    start = point(F.lit(float("inf")), F.lit(0.0), F.lit(0.0))
    corners = score_table(df, label, score).filter(first | F.col("next_pos").isNull() | bend)
    return corners.select(F.inline(F.when(first, F.array(start, own)).otherwise(F.array(own))))


def _precision_recall() -> list[Column]:
    return [
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "n_pos").alias("recall"),
    ]


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``threshold, precision, recall`` per score, and the end point (1, 0) without threshold."""
    own = F.struct(*_precision_recall())
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    last = F.col("next_pos").isNull()
    return score_table(df, label, score).select(F.inline(F.when(last, F.array(own, end)).otherwise(F.array(own))))


def pr_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(label).alias("baseline"))


def best_threshold(
    df: DataFrame, min_recall: float = 0.10, default: float = 0.5, label: str = "label", score: str = "score"
) -> DataFrame:
    """The score with the highest F1 among those whose recall reaches the floor.

    The lowest score wins ties; ``default`` where no score qualifies.
    """
    p, r = F.col("precision"), F.col("recall")
    points = score_table(df, label, score).select(*_precision_recall()).filter(r >= min_recall)
    f1 = 2 * p * r / (p + r + 1e-9)
    best = F.max_by("threshold", F.struct(f1, -F.col("threshold")))
    return points.agg(F.coalesce(best, F.lit(default)).alias("threshold"))


def apply_threshold(df: DataFrame, threshold: float | Column, score: str = "score") -> DataFrame:
    """``prediction`` from the score; rows without a score keep the model's own prediction."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    own = F.col("prediction").cast("int") if "prediction" in df.columns else F.lit(None).cast("int")
    return df.withColumn(
        "prediction", F.when(F.col(score).isNull(), own).when(F.col(score) >= t, 1).otherwise(0)
    )


def _cells(df: DataFrame, label: str, prediction: str) -> tuple[Column, Column, Column]:
    """Actual class, predicted class and number of rows: of a row, or of a cell of a confusion table."""
    if {"actual", "predicted", "count"} <= set(df.columns):
        return F.col("actual"), F.col("predicted"), F.col("count")
    return F.col(label), F.col(prediction), F.lit(1)


def _total(condition: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, n).otherwise(0)), F.lit(0))


def binary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``accuracy, precision, recall, f1`` of class 1; 0 where a denominator is 0."""
    y, p, n = _cells(df, label, prediction)
    counts = df.agg(
        _total(F.lit(True), n).alias("n"), _total(y == p, n).alias("hit"), _total((y == 1) & (p == 1), n).alias("tp"),
        _total(p == 1, n).alias("said"), _total(y == 1, n).alias("real"),
    )
    return counts.select(
        ratio(F.col("hit"), F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("said")).alias("precision"),
        ratio(F.col("tp"), F.col("real")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("real")).alias("f1"),
    )


def confusion(
    df: DataFrame, classes: Sequence[int] | None = None, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``actual, predicted, count`` for every pair of classes, empty pairs included.

    The counts, one for each pair, meet in one row, from which the grid is laid out.
    """
    counts = df.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(
        F.count("*").alias("count"))
    met = counts.agg(F.collect_list(F.struct("actual", "predicted", "count")).alias("cells"))
    if classes is None:
        known = F.array_sort(F.array_compact(F.array_distinct(F.concat("cells.actual", "cells.predicted"))))
    else:
        known = F.array(*[F.lit(int(c)) for c in classes])
    grid = met.withColumn("classes", known).withColumn("actual", F.explode("classes")).withColumn("predicted", F.explode("classes"))
    own = F.filter("cells", lambda c: (c["actual"] == F.col("actual")) & (c["predicted"] == F.col("predicted")))
    return grid.select(
        "actual", "predicted", F.aggregate(own, F.lit(0).cast("long"), lambda n, c: n + c["count"]).alias("count")
    )


def _class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, support and summed distance per class of a confusion table."""
    rows = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("class"), F.lit(True).alias("real")),
                F.struct(F.col("predicted").alias("class"), F.lit(False).alias("real")),
            )
        ).alias("side"),
        (F.col("actual") == F.col("predicted")).alias("hit"), "count",
        (F.abs(F.col("actual") - F.col("predicted")) * F.col("count")).alias("distance"),
    )
    real, n = F.col("side.real"), F.col("count")
    sums = rows.groupBy(F.col("side.class").alias("class_id")).agg(
        F.sum(F.when(real & F.col("hit"), n).otherwise(0)).alias("tp"),
        F.sum(F.when(real, n).otherwise(0)).alias("real"),
        F.sum(F.when(~real, n).otherwise(0)).alias("said"),
        F.sum(F.when(real, F.col("distance")).otherwise(0)).alias("distance"),
    )
    return sums.select(
        "class_id", "tp", "distance",
        ratio(F.col("tp"), F.col("said")).alias("precision"),
        ratio(F.col("tp"), F.col("real")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("real")).alias("f1"),
        F.col("real").cast("double").alias("support"),
    )


_RATES = ("precision", "recall", "f1")


def report(matrix: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Classification report of a confusion table, one row per class and summary.

    ``position`` orders the rows. The accuracy row repeats the accuracy in every column.
    """
    name = F.col("class_id").cast("string")
    if names is not None:
        name = F.element_at(F.array(*map(F.lit, names)), F.col("class_id") + 1)
    total = F.sum("support")
    accuracy = ratio(F.sum("tp"), total)

    def line(position: Column, title: Column, values: Sequence[Column]) -> Column:
        cells = [v.alias(c) for v, c in zip(values, (*_RATES, "support"), strict=True)]
        return F.struct(position.cast("int").alias("position"), title.alias("class_name"), *cells)

    per_class = F.collect_list(line(F.col("class_id"), name, [*map(F.col, _RATES), F.col("support")]))
    summaries = F.array(
        line(F.lit(1001), F.lit("accuracy"), [accuracy] * 4),
        line(F.lit(1002), F.lit("macro avg"), [*[F.avg(c) for c in _RATES], total]),
        line(F.lit(1003), F.lit("weighted avg"), [*[ratio(F.sum(F.col(c) * F.col("support")), total) for c in _RATES], total]),
    )
    rows = _class_scores(matrix).agg(per_class.alias("classes"), summaries.alias("summaries"))
    return rows.select(F.inline(F.concat("classes", "summaries"))).orderBy("position")


def intensity_report(matrix: DataFrame) -> DataFrame:
    return report(matrix, INTENSITY_NAMES)


def mean_f1(matrix: DataFrame) -> DataFrame:
    """``macro_f1`` and ``weighted_f1`` of a confusion table."""
    return _class_scores(matrix).agg(
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def ordinal_mae(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p, n = _cells(df, label, prediction)
    return df.agg(F.try_divide(F.sum(F.abs(y - p) * n), F.sum(n)).alias("mae"))


def _summary_row(found: DataFrame, model: str, split: str, *more: Column) -> DataFrame:
    key = [F.lit(model).alias("model_name"), F.lit(split).alias("split_name")]
    return found.select(*key, *[F.round(c, 4).alias(c) for c in found.columns], *more)


def binary_summary(df: DataFrame, model: str, split: str, scores: DataFrame | None = None) -> DataFrame:
    """One summary row, four decimals; ``df`` is scored rows, or their confusion beside their score table."""
    area = auc(df if scores is None else scores).select("roc_auc").scalar()
    return _summary_row(binary(df), model, split, F.round(area, 4).alias("roc_auc"))


def intensity_summary(df: DataFrame, model: str, split: str) -> DataFrame:
    """One summary row of predicted rows or their confusion, four decimals."""
    matrix = df if {"actual", "predicted"} <= set(df.columns) else confusion(df)
    total = F.sum("support")
    found = _class_scores(matrix).agg(
        ratio(F.sum("tp"), total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
        F.try_divide(F.sum("distance"), total).alias("mae"),
    )
    return _summary_row(found, model, split)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, matched by column name, repeats kept."""
    return reduce(DataFrame.unionByName, frames)
