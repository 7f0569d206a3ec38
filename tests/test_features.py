import math
import random
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from textsignal import session
from textsignal.functions import text
from textsignal.functions.lexicon import ANXIETY
from textsignal.operators import features, models
from textsignal.sources import tables

TEXTS = ["alpha beta alpha", "alpha beta gamma", "beta gamma delta", "worried alpha fear", "alpha beta"]


def table(spark, texts=TEXTS, communities=("jobs", "openai", "jobs", "jobs", "openai")):
    data = [(i, t, c) for i, (t, c) in enumerate(zip(texts, communities, strict=True))]
    return spark.createDataFrame(data, "comment_id long, clean_body string, subreddit string")


def small(**options):
    return features.pipeline(**{"stop_words": [], "min_df": 1, "max_df": 1.0, **options})


def expected(texts):
    """TF-IDF of words and bigrams, L2-normal, straight from the formula."""
    docs = [t.split() for t in texts]
    docs = [d + [" ".join(p) for p in zip(d, d[1:])] for d in docs]
    df = Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        w = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in Counter(d).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / norm for t, v in w.items()})
    return out


def entries(model, df):
    names = features.feature_names(model)
    found = features.featurize(model, df).select(
        "comment_id", features.vector_entries(F.col("features")).alias("e")
    ).orderBy("comment_id").collect()
    return [{names[e["slot"]]: e["value"] for e in r["e"]} for r in found]


def test_weights_follow_the_formula(spark):
    texts = [t for t in TEXTS if "worried" not in t]
    df = table(spark, texts, ["jobs"] * 4)
    for row, want in zip(entries(small().fit(df), df), expected(texts), strict=True):
        found = {k.removeprefix("text__"): v for k, v in row.items() if k.startswith("text__")}
        assert found == pytest.approx(want)
        assert row["subreddit__x0_jobs"] == 1.0


def test_fold_models_are_those_of_the_other_folds(spark):
    """Vocabulary, idf, range and communities of each fold come from all counts less its own."""
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega", "fear"]
    data = [
        (i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), rng.choice(["jobs", "openai", None, f"only{i}"]), i % 3, i % 2)
        for i in range(40)
    ]
    df = spark.createDataFrame(data, "comment_id long, clean_body string, subreddit string, fold int, label int")
    for options in ({"min_df": 2, "max_df": 0.7}, {"size": 5, "mask": None, "max_communities": 2}):
        shared, models = features.fit_folds(small(**options), df, "fold", 3, ["comment_id", "label"])
        assert "clean_body" not in shared.columns and shared.count() == 40
        for k, model in enumerate(models):
            own = small(**options).fit(df.filter(F.col("fold") != k))
            assert features.feature_names(model) == features.feature_names(own)
            for got, want in zip(entries(model, shared), entries(own, df), strict=True):
                assert got == pytest.approx(want)


def test_only_the_most_frequent_communities_are_kept(spark):
    df = table(spark, TEXTS + ["alpha", "beta"], ["jobs", "b", "jobs", "a", "b", "c", None])
    assert [n for n in features.feature_names(small(max_communities=2).fit(df)) if n.startswith("sub")] == ["subreddit__x0_b", "subreddit__x0_jobs"]
    assert [n for n in features.feature_names(small(max_communities=3).fit(df)) if n.startswith("sub")] == [f"subreddit__x0_{c}" for c in ("a", "b", "jobs")]
    model = small(max_communities=2).fit(df)
    hot = [[n for n in e if n.startswith("sub")] for e in entries(model, df)]
    assert hot == [["subreddit__x0_jobs"], ["subreddit__x0_b"], ["subreddit__x0_jobs"], [], ["subreddit__x0_b"], [], ["subreddit__x0_b"]]


def test_masked_words_are_no_features(spark):
    df = table(spark)
    masked = features.feature_names(small(mask=ANXIETY).fit(df))
    assert not {f"text__{t}" for t in ANXIETY.terms} & set(masked)
    assert {"text__worried", "text__fear"} <= set(features.feature_names(small(mask=None).fit(df)))


def test_vocabulary_limits(spark):
    df = table(spark)
    names = features.feature_names(small(mask=None, min_df=2, max_df=0.5).fit(df))
    assert names[:-3] == ["text__beta gamma", "text__gamma"]
    assert features.feature_names(small(size=2).fit(df))[:2] == ["text__alpha", "text__beta"]
    with pytest.raises(ValueError, match="empty vocabulary"):
        small(min_df=99).fit(df)


def test_unseen_community_and_length_beyond_the_training_range(spark):
    model = small().fit(table(spark))
    new = table(spark, ["alpha " * 20, "zeta"], ["elsewhere", None])
    first, second = entries(model, new)
    assert not [k for k in first if k.startswith("subreddit")]
    assert first["meta__text_len"] > 1 > second.get("meta__text_len", 0)
    assert second["subreddit__x0_jobs"] == 1.0  # null becomes the most frequent value


def test_constant_length_scales_to_zero(spark):
    df = table(spark, ["aa bb", "cc dd", "ee ff", "gg hh", "ii jj"])
    assert all("meta__text_len" not in row for row in entries(small().fit(df), df))


def test_most_frequent_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "s string")
    assert features.most_frequent(df, "s").first()[0] == "a"


def test_token_limit(spark):
    df = table(spark)
    assert not [n for n in features.feature_names(small(max_tokens=1).fit(df)) if " " in n]


def test_feature_model_survives_a_round_trip(spark, tmp_path):
    df = table(spark)
    model = small().fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert entries(again, df) == entries(model, df)


def test_a_fit_reads_even_parts_and_computes_terms_once(spark, tmp_path):
    """All rows lie in one file, which is one task: the stored terms and vectors are spread evenly all the same."""
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "panic"]) for _ in range(9)), "jobs", i % 2) for i in range(4000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(data, "comment_id long, clean_body string, subreddit string, label int").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    model, stored, to_vectors = features.fit_stored(features.pipeline(), rows, ["comment_id"])
    files = [r[0] for r in stored.groupBy(F.input_file_name()).count().select("count").collect()]
    assert "clean_body" not in stored.columns and sum(files) == 4000
    assert len(files) >= 8 and max(files) <= 2 * sum(files) / len(files)
    assert features.feature_names(model) == features.feature_names(features.pipeline().fit(rows))
    assert entries(to_vectors, stored) == entries(model, rows)
    _, vectors, sizes = models.training_vectors(rows, features.pipeline())
    assert vectors.count() == 4000 and sizes == {0: 2000, 1: 2000}
    assert max(len(list(p)) for p in vectors.rdd.glom().collect()) <= 2 * 4000 / vectors.rdd.getNumPartitions()
    assert models.Fitted(model, models.logistic(sizes).fit(vectors)).score(rows).rdd.getNumPartitions() >= 8


def test_tokens_of_ascii_text_are_those_of_the_general_rule(spark):
    texts = ["a bb_2 c-d ee", "x\u00e9\u00e9 stra\u00dfe \u0661\u0662 a", "", None, "tab\tline\nA1 0 __"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.select("i", text.tokens(F.col("t")).alias("w")).orderBy("i").select("w").collect()]
    assert found == [["bb_2", "ee"], ["xee", "stra\u00dfe", "\u0661\u0662"], [], [], ["tab", "line", "a1", "__"]]


def test_stored_rows_hold_words_and_readers_make_pairs(spark):
    df = spark.createDataFrame([(i, "river stone " * (1 + i % 3) + "hill", "jobs", i % 2) for i in range(12)], "comment_id long, clean_body string, subreddit string, fold int")
    made = features.pipeline(mask=None, stop_words=[], min_df=1, max_df=1.0)
    model, stored, to_vectors = features.fit_stored(made, df, ["comment_id"])
    assert "_terms" not in stored.columns and {r["n"] for r in stored.selectExpr("size(_words) as n").collect()} == {3, 5, 7}
    names = features.feature_names(model)
    assert {"text__river stone", "text__stone river", "text__stone hill"} < set(names)
    plain = made.fit(df)
    assert features.feature_names(plain) == names

    def vectors(table):
        return {r["comment_id"]: r["features"].toArray().round(12).tolist() for r in table.collect()}

    assert vectors(features.featurize(to_vectors, stored)) == vectors(features.featurize(plain, df))
    rows, models = features.fit_folds(made, df, "fold", 2, ["comment_id"])
    assert "_terms" not in rows.columns and all("text__stone hill" in features.feature_names(m) for m in models)


def test_written_stages_leave_no_shuffle_files(spark, tmp_path):
    """A stage's rows are read again though the files that dealt them out are gone."""
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    rows = spark.range(5000).selectExpr("id % 7 AS key", "id").repartition(4, "key")
    before = spark.conf.get(session.SHUFFLES_GO, "false")
    files = shuffled()
    kept = tables.cut_lineage(rows, "kept")
    again = tables.cut_lineage(rows.groupBy("key").count(), "counts")
    assert shuffled() <= files
    assert kept.count() == rows.count() == 5000 and again.count() == 7
    assert spark.conf.get(session.SHUFFLES_GO, "false") == before
    with session.without_shuffles(spark):
        assert spark.conf.get(session.SHUFFLES_GO) == "true"
