import os
import pathlib
import subprocess
import sys

import pytest
from compare import compare, connect
from conftest import DATA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textsignal.functions.lexicon import STOP_WORDS
from textsignal import fixtures
from textsignal.operators import features, label, sample
from textsignal.plans import catalog, jobs
from textsignal.session import shared_folder
from textsignal.sources import tables

FOLDER = str(DATA / "sf0.001")
SQL = entry.oracle_sql()
# Queries that fit models have no SQL; test_models.py covers their parts.
FITTED = {
    "f01_logistic", "f02_calibrated_svm", "f04_grid_search_logistic", "f04_grid_search_svm", "f05_scores",
    "f08_intensity_logistic", "f09_intensity_svm", "f10_refit_temporal", "g10_feature_importance", "x05_fixed_penalty",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql_or_fits_a_model():
    assert set(catalog.QUERIES) == (set(SQL) & set(catalog.QUERIES)) | FITTED


def test_sql_needs_neither_a_session_nor_the_installation(tmp_path):
    code = (
        "import builtins, sys; kept = builtins.open\n"
        "import __spark_entry__ as e\n"
        "def refuse(*a, **b): raise OSError(a)\n"
        "builtins.open = refuse\n"
        "import os, glob; glob.glob = os.listdir = os.scandir = refuse\n"
        "sql = e.oracle_sql(); from pyspark.sql import SparkSession\n"
        "assert SparkSession.getActiveSession() is None and len(sql) >= 77"
    )
    root = pathlib.Path(entry.__file__).parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"SPARK_HOME": str(tmp_path)})


def test_stop_words_are_those_of_spark(spark):
    assert list(STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize("name", sorted(set(SQL) & set(catalog.QUERIES)))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], SQL[name], FOLDER) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_no_python_function_in_the_label_plan(spark):
    plan = catalog.labelled(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_scan_reads_the_needed_columns_only(spark):
    plan = catalog.labelled(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "comments")
    tables.write_labelled(catalog.labelled(spark, FOLDER), path)
    plan = tables.read_comments(spark, path).filter("yyyy = 2024 AND mm = 3")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(yyyy" in plan.toString() or "PartitionFilters: [isnotnull(cast" in plan.toString()


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())


def test_csv_keeps_free_text(spark, tmp_path):
    texts = ['a "quoted", text', "two\nlines", " edge ", "back\\slash", "", None, "\\N"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "comment_id long, body string")
    tables.write_labelled_csv(df, str(tmp_path / "csv"))
    again = tables.read_labelled_csv(spark, str(tmp_path / "csv"), df.schema).orderBy("comment_id")
    assert [r["body"] for r in again.collect()] == texts


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12) | st.sampled_from([None, "\\n", "\\s", "\r\n", "\\\\n\n", '""', '",\n"', "#", "\x00"]), max_size=20))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_csv_round_trip(spark, tmp_path_factory, texts):
    path = str(tmp_path_factory.mktemp("csv") / "t")
    df = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "comment_id long, body string, label int").coalesce(1)
    tables.write_labelled_csv(df, path)
    assert [r["body"] for r in tables.read_labelled_csv(spark, path, df.schema).orderBy("comment_id").collect()] == texts


def test_one_large_csv_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.range(6000).select(F.col("id").alias("comment_id"), F.concat(F.lit('a "quoted"\nline\\\r'), F.repeat(F.lit("x, "), 60), F.col("id")).alias("body"))
    tables.write_labelled_csv(df.coalesce(1), path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        again = tables.read_labelled_csv(spark, path, df.schema)
        assert again.rdd.getNumPartitions() > 4
        assert again.exceptAll(df).isEmpty() and again.count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_csv_of_others_may_have_rows_over_several_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('comment_id,body\n1,"two\nlines \\n"\n2,plain\n')
    found = tables.read_labelled_csv(spark, str(tmp_path / "x.csv"), "comment_id long, body string", multi_line=True)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "two\nlines \\n"), (2, "plain")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_of_months_are_pruned(spark, tmp_path):
    """The label job writes by month; year split and both sides of a cut in time read their months alone."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    stored = str(tmp_path / "comments")
    fixtures.comments(spark, FOLDER).write.parquet(stored)
    comments = tables.read_comments(spark, stored)
    found = jobs.label_job(spark, comments, str(tmp_path / "out"))
    assert found.columns == [*comments.columns, "clean_body", "label", "subreddit_type"]
    assert dict(found.dtypes)["yyyy"] == dict(found.dtypes)["mm"] == "int"
    same = label.labelled(comments).withColumn("subreddit_type", label.community_type(F.col("subreddit")))
    assert found.exceptAll(same).isEmpty() and same.exceptAll(found).isEmpty()
    months = {tuple(r) for r in found.select("yyyy", "mm").distinct().collect()}
    assert {tuple(r) for r in label.by_year(found).select("yyyy", "mm").distinct().collect()} == {m for m in months if m[0]}

    one = label.by_year(found).filter("split = 'train'")
    assert "PartitionFilters: [" in plan_of(one) and "PartitionFilters: []" not in plan_of(one)
    rows = jobs.modelling_rows(found)
    dated = label.with_period(rows)
    cut = sample.temporal_cut(dated)
    split = cut.split(dated)
    for side, name in ((cut.early(dated), "train"), (cut.late(dated), "test")):
        want = split.filter(F.col("split") == name).drop("split")
        assert side.exceptAll(want).isEmpty() and want.exceptAll(side).isEmpty() and not side.isEmpty()
        assert "* 100" in plan_of(side).split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_tfidf_rows_move_once(spark):
    """One exchange places the texts; counts and norms need none."""
    rows = spark.createDataFrame([(i, ["a", "b", "a"]) for i in range(9)], "comment_id long, terms array<string>")
    words = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, idf double")
    plan = features.term_weights(rows, "comment_id", "terms", words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1


def test_label_pass_has_one_expression_for_all_lists(spark):
    plan = catalog.labelled(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all") == 1 and "rlike" not in plan


def test_whole_stages_have_all_rows(spark):
    n = {r.stage: r.n for r in entry.queries()["x07_whole_stages"](spark, FOLDER).collect()}
    by_label = entry.queries()["x06_stages"](spark, FOLDER).collect()
    assert n["labelled"] == n["filtered"] == catalog.labelled(spark, FOLDER).count() >= n["features"] > 0
    assert n == {stage: sum(r.n for r in by_label if r.stage == stage) for stage in n}
