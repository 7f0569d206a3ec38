import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from textsignal.operators import evaluate
from textsignal.sources import tables

# Published confusion counts, actual class by predicted class.
BINARY = {
    ("logistic_regression", "random_stratified"): ((251, 2), (15, 1)),
    ("linear_svm", "random_stratified"): ((251, 2), (15, 1)),
    ("logistic_regression", "temporal_chronological_70_30"): ((349, 30), (19, 5)),
    ("linear_svm", "temporal_chronological_70_30"): ((355, 24), (19, 5)),
}
# Published accuracy, precision, recall, F1.
BINARY_RATES = {
    ("logistic_regression", "random_stratified"): (0.9368, 0.3333, 0.0625, 0.1053),
    ("linear_svm", "random_stratified"): (0.9368, 0.3333, 0.0625, 0.1053),
    ("logistic_regression", "temporal_chronological_70_30"): (0.8784, 0.1429, 0.2083, 0.1695),
    ("linear_svm", "temporal_chronological_70_30"): (0.8933, 0.1724, 0.2083, 0.1887),
}
INTENSITY = {
    ("logistic_regression", "random_stratified"): ((251, 1, 0), (13, 1, 0), (1, 2, 0)),
    ("linear_svm", "random_stratified"): ((252, 0, 0), (13, 1, 0), (2, 1, 0)),
    ("logistic_regression", "temporal_chronological_70_30"): ((376, 0, 3), (16, 1, 1), (3, 2, 1)),
    ("linear_svm", "temporal_chronological_70_30"): ((379, 0, 0), (17, 0, 1), (5, 1, 0)),
}
# Published accuracy, macro F1, weighted F1, mean absolute error.
INTENSITY_RATES = {
    ("logistic_regression", "random_stratified"): (0.9368, 0.3607, 0.9154, 0.0669),
    ("linear_svm", "random_stratified"): (0.9405, 0.3654, 0.9162, 0.0669),
    ("logistic_regression", "temporal_chronological_70_30"): (0.938, 0.4162, 0.9207, 0.0769),
    ("linear_svm", "temporal_chronological_70_30"): (0.9404, 0.3239, 0.9139, 0.072),
}
# Published report of the binary models on the random split.
BINARY_REPORT = [
    ("0", 0.943609022556391, 0.9920948616600791, 0.9672447013487476, 253.0),
    ("1", 0.3333333333333333, 0.0625, 0.10526315789473684, 16.0),
    ("accuracy", *[0.9368029739776952] * 4),
    ("macro avg", 0.6384711779448622, 0.5272974308300395, 0.5362539296217422, 269.0),
    ("weighted avg", 0.9073100968033467, 0.9368029739776952, 0.9159744236711855, 269.0),
]
# Published report of logistic regression on the temporal split.
INTENSITY_REPORT = [
    ("none", 0.9518987341772152, 0.9920844327176781, 0.9715762273901809, 379.0),
    ("low", 0.3333333333333333, 0.05555555555555555, 0.09523809523809523, 18.0),
    ("medium", 0.2, 0.16666666666666666, 0.18181818181818182, 6.0),
    ("accuracy", *[0.9379652605459057] * 4),
    ("macro avg", 0.4950773558368495, 0.4047688849799668, 0.416210834815486, 403.0),
    ("weighted avg", 0.9130759807770832, 0.9379652605459057, 0.9206763895436063, 403.0),
]
# Published Markdown lines.
MARKDOWN = [
    "| Model | Split | Accuracy | Macro F1 | Weighted F1 | MAE |",
    "|---|---|---|---|---|---|",
    "| linear_svm | random_stratified | 0.9405 | 0.3654 | 0.9162 | 0.0669 |",
    "| logistic_regression | random_stratified | 0.9368 | 0.3607 | 0.9154 | 0.0669 |",
    "| linear_svm | temporal_chronological_70_30 | 0.9404 | 0.3239 | 0.9139 | 0.0720 |",
    "| logistic_regression | temporal_chronological_70_30 | 0.9380 | 0.4162 | 0.9207 | 0.0769 |",
]


def expand(spark, matrix):
    """One row per counted pair."""
    cells = [(a, p, n) for a, line in enumerate(matrix) for p, n in enumerate(line) if n]
    counts = spark.createDataFrame(cells, "label int, prediction int, n int")
    return counts.select("label", "prediction", F.explode(F.expr("sequence(1, n)")).alias("i"))


@pytest.mark.parametrize("case", BINARY)
def test_published_binary_rates(spark, case):
    found = evaluate.binary(expand(spark, BINARY[case])).first()
    assert tuple(round(v, 4) for v in found) == BINARY_RATES[case]


@pytest.mark.parametrize("case", INTENSITY)
def test_published_intensity_rates(spark, case):
    found = evaluate.intensity_summary(expand(spark, INTENSITY[case]), *case).first()
    assert tuple(found)[2:] == INTENSITY_RATES[case]


@pytest.mark.parametrize(
    "matrix, expected, names",
    [
        (BINARY["linear_svm", "random_stratified"], BINARY_REPORT, None),
        (INTENSITY["logistic_regression", "temporal_chronological_70_30"], INTENSITY_REPORT, evaluate.INTENSITY_NAMES),
    ],
)
def test_published_reports(spark, matrix, expected, names):
    found = evaluate.report(evaluate.confusion(expand(spark, matrix)), names).drop("position").collect()
    assert [r["class_name"] for r in found] == [e[0] for e in expected]
    for row, want in zip(found, expected, strict=True):
        assert tuple(row)[1:] == pytest.approx(want[1:], abs=1e-12)


def test_confusion_keeps_empty_cells(spark):
    matrix = INTENSITY["linear_svm", "random_stratified"]
    found = {(r["actual"], r["predicted"]): r["count"] for r in evaluate.confusion(expand(spark, matrix)).collect()}
    assert found == {(a, p): n for a, line in enumerate(matrix) for p, n in enumerate(line)}
    four = evaluate.confusion(expand(spark, matrix), [0, 1, 2, 3])
    assert four.count() == 16 and four.agg(F.sum("count")).first()[0] == 269


def test_markdown(spark, tmp_path):
    summary = evaluate.union_all(
        [evaluate.intensity_summary(expand(spark, INTENSITY[c]), *c) for c in INTENSITY]
    )
    tables.write_markdown(summary, str(tmp_path / "table"))
    files = list((tmp_path / "table").glob("part-*"))
    assert len(files) == 1
    assert files[0].read_text().splitlines() == MARKDOWN


def brute_auc(data):
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_points(data):
    out = []
    for t in sorted({s for _, s in data}):
        said = [y for y, s in data if s >= t]
        out.append((t, sum(said), len(said) - sum(said)))
    return out


@pytest.fixture(params=["true", "false"], ids=["ranges put together", "every range"])
def ranges(request, spark):
    """Spark puts small partitions together, or leaves the score ranges as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def data():
    rng = random.Random(3)
    return [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)] + [(0, 0.5)] * 200


def frame(spark, data):
    return spark.createDataFrame(data, "label int, score double").repartition(5)


def test_auc(spark, data, ranges):
    assert evaluate.auc(frame(spark, data)).first()[0] == pytest.approx(brute_auc(data), abs=1e-12)


def test_auc_is_null_with_one_class(spark, ranges):
    assert evaluate.auc(frame(spark, [(1, 0.2), (1, 0.9)])).first()[0] is None
    assert evaluate.auc(frame(spark, [(0, 0.2)])).first()[0] is None


def test_auc_without_scores_is_null_and_nan_is_an_error(spark):
    none = spark.createDataFrame([(1, None), (0, None)], "label int, score double")
    assert evaluate.auc(none).first()[0] is None
    some = spark.createDataFrame([(1, None), (1, 0.9), (0, 0.1), (0, None)], "label int, score double")
    assert evaluate.auc(some).first()[0] == 1.0
    with pytest.raises(Exception, match="NaN"):
        evaluate.auc(spark.createDataFrame([(1, math.nan), (0, 0.2)], "label int, score double")).first()


def test_a_model_without_scores_has_a_blank_cell(spark):
    df = spark.createDataFrame([(1, None, 1), (0, None, 0), (0, None, 1)], "label int, score double, prediction int")
    line = tables.markdown_rows(evaluate.binary_summary(df, "m", "s")).first()["line"]
    assert line == "| m | s | 0.6667 | 0.5000 | 1.0000 | 0.6667 |  |"


def test_each_result_reads_its_input_once(spark, data, tmp_path):
    path = str(tmp_path / "scored")
    evaluate.apply_threshold(frame(spark, data), 0.5).write.parquet(path)
    df = spark.read.parquet(path)
    table, matrix = evaluate.score_table(df), evaluate.confusion(df, [0, 1])

    def scans(found):
        return found._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    for found in (evaluate.roc_curve(df), evaluate.pr_curve(df), evaluate.auc(table), evaluate.best_threshold(table),
                  matrix, evaluate.confusion(df), evaluate.report(matrix), evaluate.mean_f1(matrix),
                  evaluate.intensity_summary(df, "m", "s")):
        assert scans(found) == 1
    assert scans(evaluate.binary_summary(df, "m", "s", table)) == 2  # the rows and the score table


def test_rows_and_their_tables_give_the_same(spark, data):
    df = evaluate.apply_threshold(frame(spark, data), 0.5)
    table, matrix = evaluate.score_table(df), evaluate.confusion(df, [0, 1])
    assert evaluate.score_table(table) is table
    assert rows(evaluate.binary(df)) == rows(evaluate.binary(matrix))
    assert rows(evaluate.ordinal_mae(df)) == rows(evaluate.ordinal_mae(matrix))
    assert rows(evaluate.binary_summary(df, "m", "s")) == rows(evaluate.binary_summary(matrix, "m", "s", table))
    assert rows(evaluate.intensity_summary(df, "m", "s")) == rows(evaluate.intensity_summary(matrix, "m", "s"))


def test_pr_curve(spark, data, ranges):
    n_pos = sum(y for y, _ in data)
    want = [(t, tp / (tp + fp), tp / n_pos) for t, tp, fp in brute_points(data)] + [(None, 1.0, 0.0)]
    assert rows(evaluate.pr_curve(frame(spark, data))) == sorted(want, key=repr)


def test_roc_curve_keeps_corners_only(spark, data, ranges):
    n_pos = sum(y for y, _ in data)
    n_neg = len(data) - n_pos
    points = [(t, fp, tp) for t, tp, fp in reversed(brute_points(data))]
    keep = [
        p for i, p in enumerate(points)
        if i in (0, len(points) - 1)
        or any(points[i + 1][k] - 2 * p[k] + points[i - 1][k] for k in (1, 2))
    ]
    want = [(math.inf, 0.0, 0.0)] + [(t, fp / n_neg, tp / n_pos) for t, fp, tp in keep]
    assert rows(evaluate.roc_curve(frame(spark, data))) == sorted(want, key=repr)


def test_best_threshold(spark, data, ranges):
    n_pos = sum(y for y, _ in data)
    best, want = -1.0, 0.5
    for t, tp, fp in brute_points(data):
        p, r = tp / (tp + fp), tp / n_pos
        if r >= 0.1 and 2 * p * r / (p + r + 1e-9) > best:
            best, want = 2 * p * r / (p + r + 1e-9), t
    assert evaluate.best_threshold(frame(spark, data)).first()[0] == want


def test_best_threshold_defaults(spark):
    one = frame(spark, [(1, 0.9), (0, 0.8)])
    assert evaluate.best_threshold(one, min_recall=1.1).first()[0] == 0.5
    assert evaluate.best_threshold(frame(spark, [(0, 0.8)])).first()[0] == 0.5


def test_lowest_threshold_wins_ties(spark):
    # At 0.3: precision 1/2, recall 1. At 0.9: precision 1, recall 1/2.
    data = [(1, 0.9), (1, 0.3), (0, 0.6), (0, 0.5)]
    found = evaluate.best_threshold(frame(spark, data)).first()[0]
    assert found == pytest.approx(0.3)


def test_apply_threshold_falls_back_to_the_prediction(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.4, 1.0), (None, 1.0)], "score double, prediction double")
    assert [r["prediction"] for r in evaluate.apply_threshold(df, 0.5).orderBy("score").collect()] == [1, 0, 1]


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert tuple(evaluate.binary(df).first()) == (1.0, 0.0, 0.0, 0.0)
