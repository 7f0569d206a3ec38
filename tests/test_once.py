"""Work that is done once a row, or once a term, however long the lists are."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from textsignal.functions import text
from textsignal.functions.lexicon import AI, AI_SUBSTRINGS, ANXIETY, ANXIETY_SUBSTRINGS, OPTIMISM_SUBSTRINGS, Lexicon
from textsignal.operators import features
from textsignal.sources import tables


def plan_of(df):
    shown = io.StringIO()
    with redirect_stdout(shown):
        df.explain()
    return shown.getvalue()


def test_lists_of_substrings_read_a_text_once(spark):
    body = F.reverse(F.lower("t"))
    for lexicon in (AI_SUBSTRINGS, ANXIETY_SUBSTRINGS, OPTIMISM_SUBSTRINGS, AI, ANXIETY):
        rows = spark.createDataFrame([("x",)], "t string").repartition(2).select(text.hits(body, lexicon).alias("n"))
        assert plan_of(rows).count("reverse(") == 1, lexicon.name


def test_substrings_that_overlap_or_begin_each_other(spark):
    values = ["gpt-4 gpt4", "llms automated", "ai tool ai toolai job", "", None, "stressed doomed doom", "can't find a jobno job", "a.i. aai. i"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    for lexicon in (AI_SUBSTRINGS, ANXIETY_SUBSTRINGS):
        got = [r[0] for r in df.orderBy("i").select(text.hits(F.col("t"), lexicon)).collect()]
        assert got == [sum(t in (v or "") for t in lexicon.terms) for v in values]


def test_words_of_lists_are_found_by_one_pass_over_the_text(spark):
    """Plain words meet the text's words; of the expressions, only those of terms that are no plain word look around."""
    odd = Lexicon("odd", ("ai", "a.i", "c++", "ai tool", "été", "[x]", "x_1", "ai t"))
    values = ["ai-tool a.i.", "AI", "ai tool", "été, c++ [x] x_1", "étés c+++ x_12 aix", "xai ai_ ai", "ai  tool", "ai t ai", "日ai ai日 a.i日", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    for lexicon in (odd, AI, ANXIETY):
        found = df.select("i", text.found_terms(F.col("t"), lexicon).alias("found"), *[F.col("t").rlike(lexicon.pattern(x)).alias(f"m{k}") for k, x in enumerate(lexicon.terms)])
        for r in found.collect():
            assert len(r["found"]) == len(set(r["found"]))
            assert set(r["found"]) == {x for k, x in enumerate(lexicon.terms) if r[f"m{k}"]}, values[r["i"]]
    plan = plan_of(df.select(text.found_terms(F.reverse("t"), ANXIETY).alias("n")))
    assert "(?=" not in plan and plan.count("reverse(") == 1


def test_pairs_are_joined_without_a_list_for_each(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],), (None,)], "w array<string>")
    pairs = df.select(text.with_bigrams(F.col("w")).alias("p"))
    assert "concat_ws" not in plan_of(pairs)
    assert [r["p"] for r in pairs.collect()] == [["a", "b", "a", "a b", "b a"], ["a"], [], None]


def test_accents_are_stripped_from_one_value(spark):
    rows = spark.createDataFrame([("x",)], "t string").repartition(2).select(text.strip_accents(F.reverse(F.lower("t"))).alias("n"))
    assert plan_of(rows).count("reverse(") == 1


def test_marks_beside_letters_of_every_kind(spark):
    values = ["café", "ͅxุ", "aःb", "한글", "ﬁẛ̣", "\U00010f46z", "plain", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.strip_accents(F.col("t"))).collect()]
    assert got == [None if v is None else text.without_marks(v) for v in values]


def test_terms_are_counted_without_a_function_for_each(spark):
    values = [(0, ["b", "a", "b"]), (1, ["b"]), (1, []), (0, ["a b", "a"]), (0, None)]
    df = spark.createDataFrame(values, "fold int, terms array<string>")
    counts = features.term_counts(df, "terms", "fold", 2)
    assert "lambdafunction" not in plan_of(counts)
    want = {"a": (2, 2, 2, 2, 0, 0), "b": (3, 2, 2, 1, 1, 1), "a b": (1, 1, 1, 1, 0, 0), None: (0, 4, 0, 2, 0, 2)}
    assert {r["term"]: tuple(r)[1:] for r in counts.collect()} == want


def test_tasks_of_an_iteration_follow_the_cores(spark, tmp_path):
    mb = 1 << 20
    assert [tables.n_parts(n * mb, 16 * mb, 12) for n in (0, 1, 17, 192, 193, 1536, 1537)] == [1, 1, 2, 12, 12, 12, 24]
    assert [tables.n_parts(n * mb, 16 * mb, 1) for n in (1, 58, 128, 129)] == [1, 1, 1, 2]
    path = str(tmp_path / "t")
    spark.range(200_000).repartition(40).write.parquet(path)
    size = tables.table_bytes(spark, path)
    cores = spark.sparkContext.defaultParallelism
    assert tables.compact(spark, path, part_bytes=size // 30).rdd.getNumPartitions() == cores
    assert tables.compact(spark, path, part_bytes=size // 30, at_once=cores).rdd.getNumPartitions() == 1
    assert tables.compact(spark, path, part_bytes=size // 3).count() == 200_000
