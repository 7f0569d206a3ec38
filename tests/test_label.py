import pytest
from conftest import rows
from pyspark.sql import functions as F

from textsignal.operators import label, profile
from textsignal.sources.tables import COMMENTS
from textsignal.streaming.labelling import label_new_files


def comments(spark, bodies, subreddit="jobs"):
    data = [(i, b, subreddit, 2024, 1) for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, COMMENTS)


def test_candidates_need_both_themes(spark):
    df = comments(spark, ["ai took my job", "ai is great", "my job", None, "see http://x/ai about my job"])
    assert rows(label.candidates(df).select("comment_id")) == [(0,)]


def test_negation_does_not_change_the_label(spark):
    df = label.weak_label(label.candidates(comments(spark, ["not worried about ai at work"])))
    assert df.first()["label"] == 1


def test_word_inside_a_link_counts_for_severity_only(spark):
    df = label.with_intensity(label.weak_label(label.candidates(comments(spark, ["ai job http://x.y/panic"]))))
    found = df.first()
    assert (found["label"], found["severity_score"], found["intensity_label"]) == (0, 2, 2)


def test_community_filter(spark):
    df = comments(spark, ["ai job"], "Jobs")
    assert label.candidates(df, communities=["jobs"]).count() == 1
    assert label.candidates(df, communities=["openai"]).count() == 0


def test_community_type(spark):
    df = spark.createDataFrame([(v,) for v in ("JOBS", "OpenAI", "Anxiety", "x", None)], "s string")
    found = [r[0] for r in df.select(label.community_type(F.col("s"))).collect()]
    assert found == ["career", "ai", "mental_health", "other", "other"]


@pytest.mark.parametrize(
    "sizes, want",
    [
        ((10, 9, 8, 0), {0: 10, 1: 9, 2: 8}),
        ((10, 9, 8, 4), {0: 10, 1: 9, 2: 12}),
        ((10, 9, 8, 5), {0: 10, 1: 9, 2: 8, 3: 5}),
        ((10, 9, 1, 1), {0: 10, 1: 11}),
        ((10, 9, 1, 4), {0: 10, 1: 9, 2: 5}),
        ((10, 9, 4, 5), {0: 10, 1: 13, 3: 5}),
        ((3, 0, 0, 0), {0: 3}),
    ],
)
def test_rare_levels_merge_upward_first(spark, sizes, want):
    data = [(level,) for level, n in enumerate(sizes) for _ in range(n)]
    merged = label.merge_rare(spark.createDataFrame(data, "intensity_label int"))
    assert {r[0]: r[1] for r in profile.distribution(merged, "intensity_label").collect()} == want


def test_prepare(spark):
    df = comments(spark, ["123456789", "1234567890", None, ""], None)
    assert rows(label.prepare(df).select("comment_id", "clean_body", "subreddit")) == [(1, "1234567890", "unknown")]


def test_valid_labels(spark):
    df = spark.createDataFrame([("1",), ("0.0",), ("x",), ("2",), (None,)], "label string")
    assert rows(label.valid_labels(df)) == [(0,), (1,)]


def test_period_without_month_column(spark):
    df = spark.createDataFrame([("2023",), (None,), ("x",)], "yyyy string")
    assert rows(label.with_period(df)) == [(2023, 1)]


def test_period_as_text_with_a_decimal_point(spark):
    df = spark.createDataFrame([("2023.0", "7.0"), ("2024", "x"), (None, "1"), ("nan", "2"), ("2023", None)], "yyyy string, mm string")
    assert rows(label.with_period(df)) == [(2023, 1), (2023, 7), (2024, 1)]
    assert label.with_period(df.select("mm")).collect() == []


def test_label_quality_rounds_half_to_even(spark):
    df = spark.createDataFrame([("fear", 1)] + [("fear worry", 1)] * 7, "body string, label int")
    assert tuple(profile.label_quality(df).first()) == (8, 1, 12)
    assert tuple(profile.label_quality(df.filter("label = 0")).first()) == (0, 0, 0)


def test_text_is_cleaned_once(spark):
    df = label.weak_label(label.candidates(comments(spark, ["ai job"])))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("http") == 2  # the substring test and the expression behind it


def test_labels_on_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = comments(spark, ["ai job fear", "ai job", "nothing"])
    df.write.parquet(source)
    for _ in range(2):  # the second run finds no new file
        label_new_files(spark, source, out, str(tmp_path / "progress")).awaitTermination(60)
    batch = label.weak_label(label.candidates(df))
    assert rows(spark.read.parquet(out).select("comment_id", "label")) == rows(batch.select("comment_id", "label"))


def test_profiles_from_one_aggregate(spark):
    """Equal to the profiles that read the rows themselves."""
    words = ["", "fear", "fear worry", "not worried", "http://x/panic"]
    rows = [
        (i, f"ai job {words[i % 5]}" + (" and more" if i % 4 else ""), ["Jobs", "jobs", None, "x"][i % 4], label)
        for i, label in enumerate([0, 1, None, 1, 2, 1, 0, 1, 1, 0] * 4)
    ] + [(99, None, "jobs", 1), (98, "ai", "jobs", 0)]
    df = spark.createDataFrame(rows, "comment_id long, body string, subreddit string, label int").withColumn("clean_body", F.lower("body"))
    for labelled in (df, df.limit(0)):
        found = profile.from_kinds(profile.row_kinds(labelled))
        valid = label.valid_labels(labelled)
        usable = label.prepare(valid)
        want = {
            "pool_size": profile.pool_size(labelled), "community_distribution": profile.distribution(labelled, "subreddit"),
            "label_distribution": profile.distribution(usable, "label"), "label_quality": profile.label_quality(valid),
            "label_distribution_by_subreddit": profile.distribution(usable, "subreddit", "label"), "positive_check": profile.positive_check(usable),
        }
        assert set(found) == set(want)
        for name, table in want.items():
            assert (found[name].columns, sorted(map(tuple, found[name].collect()), key=repr)) == (table.columns, sorted(map(tuple, table.collect()), key=repr)), name
