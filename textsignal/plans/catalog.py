"""One registered query per operator, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsignal import fixtures
from textsignal.functions import text
from textsignal.functions.lexicon import (
    AI, AI_SUBSTRINGS, ANXIETY, ANXIETY_SUBSTRINGS, JOB, OPTIMISM_SUBSTRINGS,
)
from textsignal.operators import evaluate, features, label, models, profile, sample
from textsignal.plans import jobs
from textsignal.session import new_path
from textsignal.sources import tables
from textsignal.sources.tables import cut_lineage, dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
THRESHOLD = 0.6


def query(name: str) -> Callable[[Query], Query]:
    def add(make: Query) -> Query:
        QUERIES[name] = make
        return make

    return add


def row_query(name: str, **columns: Callable[[], Column]) -> None:
    """Register a query that adds columns to every comment."""

    def make(spark: SparkSession, folder: str) -> DataFrame:
        made = [build().alias(c) for c, build in columns.items()]
        return fixtures.comments(spark, folder).select("comment_id", *made)

    QUERIES[name] = make


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return label.labelled(fixtures.comments(spark, folder))


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Modelling rows, not stored."""
    return label.prepare(labelled(spark, folder))


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, labels and months of the modelling rows, stored: input of the split operators."""
    rows = prepared(spark, folder).select("comment_id", "label", "subreddit", "yyyy", "mm")
    return cut_lineage(rows, "keys")


def modelling(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.modelling_rows(labelled(spark, folder))


def levels(spark: SparkSession, folder: str) -> DataFrame:
    return label.with_intensity(prepared(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.apply_threshold(fixtures.scored(spark, folder), THRESHOLD)


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """Intensity of the raw body as label, of the negation-merged text as prediction."""
    merged = label.intensity_bucket(text.severity(F.col("clean_body"), label.TIERS))
    return levels(spark, folder).select(
        "comment_id", F.col("intensity_label").alias("label"), merged.alias("prediction")
    )


def body() -> Column:
    return F.lower("body")


# Sources and sinks

@query("a01_read_comments")
def _(spark, folder):
    path = new_path(spark, "comments")
    fixtures.comments(spark, folder).write.partitionBy("yyyy", "mm").parquet(path)
    return tables.read_comments(spark, path).groupBy("yyyy", "mm").agg(
        F.count("*").alias("n"), F.sum(F.length("body")).alias("n_chars"), F.count("subreddit").alias("n_named")
    )


@query("a02_cast_period")
def _(spark, folder):
    raw = fixtures.comments(spark, folder).withColumns({c: F.col(c).cast("string") for c in ("yyyy", "mm")})
    return tables.cast_period(raw).select("comment_id", "yyyy", "mm")


@query("a03_read_labelled_csv")
def _(spark, folder):
    path = new_path(spark, "labelled-csv")
    rows = labelled(spark, folder).withColumn("subreddit_type", label.community_type(F.col("subreddit")))
    tables.write_labelled_csv(rows.select(tables.LABELLED.fieldNames()), path)
    return tables.read_labelled_csv(spark, path).select(
        "comment_id", F.md5("body").alias("body_md5"), "subreddit", "yyyy", "mm",
        F.md5("clean_body").alias("clean_md5"), "label", "subreddit_type",
    )


@query("a04_write_labelled")
def _(spark, folder):
    path = new_path(spark, "labelled")
    tables.write_labelled(labelled(spark, folder), path)
    return spark.read.parquet(path).groupBy("yyyy", "mm", "label").agg(
        F.count("*").alias("n"), F.sum(F.length("clean_body")).alias("n_chars")
    )


@query("a05_reuse_stage")
def _(spark, folder):
    """The label job twice on the same table, which is one stage, and once on rows of one year, which is another."""
    out, stored = new_path(spark, "job"), new_path(spark, "comments")
    fixtures.comments(spark, folder).write.parquet(stored)
    comments = tables.read_comments(spark, stored)
    first = jobs.label_job(spark, comments, out).count()
    again = jobs.label_job(spark, comments, out)
    made = len({f.split("/labelled/")[1].split("/")[0] for f in spark.read.parquet(f"{out}/labelled/*").inputFiles()})
    other = jobs.label_job(spark, comments.filter("yyyy = 2024"), out).count()
    return again.groupBy("label").agg(
        F.count("*").alias("n"), F.lit(first).cast("long").alias("n_first"), F.lit(other).cast("long").alias("n_other"), F.lit(made).alias("n_stages"),
    )


@query("a06_write_result")
def _(spark, folder):
    path = new_path(spark, "result")
    tables.write_result(profile.distribution(labelled(spark, folder), "label"), path)
    return spark.read.schema("label int, count long").option("header", True).csv(path)


@query("a07_markdown")
def _(spark, folder):
    return tables.markdown_rows(summaries(spark, folder))


# Text and labels

@query("b01_clean_light")
def _(spark, folder):
    return label.with_clean_body(fixtures.comments(spark, folder)).select("comment_id", "clean_body")


@query("b02_clean_full")
def _(spark, folder):
    rows = label.with_clean_body(fixtures.comments(spark, folder), text.clean_full)
    return rows.select("comment_id", "clean_body")


row_query("b03_merge_negations", merged=lambda: text.merge_negations(body()))


@query("b04_ai_filter")
def _(spark, folder):
    return label.candidates(fixtures.comments(spark, folder), AI).select("comment_id")


@query("b05_job_filter")
def _(spark, folder):
    return label.candidates(fixtures.comments(spark, folder), AI, JOB).select("comment_id")


@query("b06_weak_label")
def _(spark, folder):
    return label.weak_label(label.with_clean_body(fixtures.comments(spark, folder))).select("comment_id", "label")


row_query(
    "b07_keyword_count",
    n_anxiety=lambda: text.hits(body(), ANXIETY), n_ai=lambda: text.hits(body(), AI),
    n_job=lambda: text.hits(body(), JOB),
)
row_query("b08_severity", severity_score=lambda: text.severity(body(), label.TIERS))


@query("b09_intensity")
def _(spark, folder):
    rows = label.with_intensity(fixtures.comments(spark, folder))
    return rows.select("comment_id", "severity_score", "intensity_label")


@query("b10_merge_rare")
def _(spark, folder):
    rows = cut_lineage(levels(spark, folder).select("comment_id", "intensity_label"), "levels")
    merged = label.merge_rare(label.merge_rare(rows, 5, out="merged_5"), 50, out="merged_50")
    return merged.select("comment_id", "merged_5", "merged_50")


row_query("b11_community_type", subreddit_type=lambda: label.community_type(F.col("subreddit")))


@query("b12_valid_labels")
def _(spark, folder):
    kinds = F.array(*map(F.lit, ("x", "1.0", " 0", "2", "", "1")))
    raw = fixtures.comments(spark, folder).select(
        "comment_id", F.element_at(kinds, (F.col("comment_id") % 6 + 1).cast("int")).alias("label")
    )
    return label.valid_labels(raw)


@query("b13_min_length")
def _(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("body"))
    cleaned = label.with_clean_body(turns, text.clean_full)
    return label.long_enough(cleaned).select("conv_id", "turn", F.length("clean_body").alias("n_chars"))


row_query("b14_normal_community", subreddit=lambda: label.normal_community(F.col("subreddit")))


@query("b15_projection")
def _(spark, folder):
    return prepared(spark, folder).select("comment_id", "clean_body", "subreddit")


@query("b16_keyword_masker")
def _(spark, folder):
    masker = features.KeywordMasker(inputCol="clean_body", outputCol="masked", terms=list(ANXIETY.terms))
    return masker.transform(prepared(spark, folder)).select("comment_id", "masked")


@query("b17_text_length")
def _(spark, folder):
    measured = features.TextLength(inputCol="clean_body", outputCol="text_len").transform(prepared(spark, folder))
    return measured.select("comment_id", "text_len")


@query("b18_time_keys")
def _(spark, folder):
    """Years and months as text, some as a column with gaps is written: 2023.0, 7.0."""
    place = F.col("comment_id") % 9
    month = F.when(place == 0, "x").when(place == 1, F.concat(F.col("mm").cast("string"), F.lit(".0"))).when(
        place != 2, F.col("mm").cast("string"))
    year = F.when(place == 3, F.concat(F.col("yyyy").cast("string"), F.lit(".0"))).otherwise(F.col("yyyy").cast("string"))
    raw = fixtures.comments(spark, folder).withColumns({"yyyy": year, "mm": month})
    return label.with_period(raw).select("comment_id", "yyyy", "mm")


@query("b19_intensity_name")
def _(spark, folder):
    return levels(spark, folder).select("comment_id", label.intensity_name(F.col("intensity_label")).alias("intensity"))


@query("b20_round")
def _(spark, folder):
    return scored(spark, folder).select("comment_id", F.round("score", 4).alias("score"))


# Profiles

@query("label_distribution")
def _(spark, folder):
    return profile.distribution(labelled(spark, folder), "label")


@query("c01_pool_size")
def _(spark, folder):
    return profile.pool_size(labelled(spark, folder))


@query("c02_label_distribution")
def _(spark, folder):
    return profile.distribution(prepared(spark, folder), "label")


@query("c03_community_distribution")
def _(spark, folder):
    return profile.distribution(labelled(spark, folder), "subreddit")


@query("c04_community_label")
def _(spark, folder):
    return profile.distribution(prepared(spark, folder), "subreddit", "label")


@query("c05_intensity_distribution")
def _(spark, folder):
    rows = cut_lineage(levels(spark, folder).select("comment_id", "intensity_label"), "levels")
    return profile.intensity_distribution(label.merge_rare(rows, 50))


@query("c06_label_quality")
def _(spark, folder):
    return profile.label_quality(prepared(spark, folder))


@query("c07_positive_check")
def _(spark, folder):
    return profile.positive_check(prepared(spark, folder))


@query("c08_class_summary")
def _(spark, folder):
    found = profile.class_summary(levels(spark, folder), "intensity_label")
    return found.select(F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"), "smallest")


@query("c09_split_audit")
def _(spark, folder):
    return profile.split_audit(sample.temporal(label.with_period(keys(spark, folder))))


# Samples and splits

@query("d01_top_k_per_class")
def _(spark, folder):
    return sample.top_k_per_class(keys(spark, folder), 100).select("comment_id", "label")


@query("d02_shuffle")
def _(spark, folder):
    rows = labelled(spark, folder).select("comment_id", sample.row_hash(44).alias("row_hash"))
    return sample.shuffled(rows, 44)


@query("d03_union")
def _(spark, folder):
    rows = labelled(spark, folder).select("comment_id", "label")
    return evaluate.union_all([rows.filter("label = 1"), rows.select("label", "comment_id")])


@query("d03b_union_metrics")
def _(spark, folder):
    rows = fixtures.scored(spark, folder)
    named = [
        evaluate.binary(evaluate.apply_threshold(rows, t)).select(F.lit(t).alias("at"), "accuracy", "f1")
        for t in (0.3, 0.5, 0.7)
    ]
    return evaluate.union_all(named).select("at", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query("d04_stratified_split")
def _(spark, folder):
    return sample.stratified(keys(spark, folder), 0.2, 0.2).select("comment_id", "label", "split")


@query("d05_plain_split")
def _(spark, folder):
    rare = F.when(F.col("comment_id") == 0, 1).otherwise(0)
    return sample.stratified(keys(spark, folder).withColumn("label", rare), 0.2).select("comment_id", "split")


@query("d06_downsample")
def _(spark, folder):
    return sample.downsample(keys(spark, folder), 1).select("comment_id", "label")


@query("d07_temporal_split")
def _(spark, folder):
    rows = sample.temporal(label.with_period(keys(spark, folder)))
    return rows.select("comment_id", "yyyy", "mm", "split")


@query("d08_folds")
def _(spark, folder):
    return sample.folds(keys(spark, folder)).select("comment_id", "label", "fold")


@query("d09_inner_validation")
def _(spark, folder):
    split = cut_lineage(sample.temporal(label.with_period(keys(spark, folder))), "by-time")
    train = split.filter("split = 'train'").drop("split")
    return sample.inner_validation(train).select("comment_id", "label", "split")


# Features

def terms(spark: SparkSession, folder: str, max_tokens: int = 0) -> DataFrame:
    masked = features.KeywordMasker(inputCol="clean_body", outputCol="masked", terms=list(ANXIETY.terms))
    extractor = features.TermExtractor(
        inputCol="masked", outputCol="terms", stopWords=features.default_stop_words(), maxTokens=max_tokens
    )
    return extractor.transform(masked.transform(prepared(spark, folder)))


@query("e01_tokens")
def _(spark, folder):
    rows = fixtures.comments(spark, folder)
    return rows.select("comment_id", F.array_join(text.tokens(F.col("body")), " ").alias("tokens"))


@query("e13_scripts")
def _(spark, folder):
    """Tokens of the comments with their letters written in other scripts, with marks and ligatures."""
    rows = fixtures.comments(spark, folder)
    body = F.translate(F.lower("body"), "".join(fixtures.SCRIPTS), "".join(fixtures.SCRIPTS.values()))
    return rows.select("comment_id", F.array_join(text.tokens(body), " ").alias("tokens"))


@query("e02_stop_words")
def _(spark, folder):
    words = text.drop_words(text.tokens(F.col("clean_body")), features.default_stop_words())
    return prepared(spark, folder).select("comment_id", F.array_join(words, " ").alias("words"))


@query("e03_bigrams")
def _(spark, folder):
    rows = terms(spark, folder)
    return rows.select("comment_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("terms_md5"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return features.vocabulary(terms(spark, folder), "terms", 2, 0.95, 30_000)


@query("e04_vocabulary")
def _(spark, folder):
    return vocabulary(spark, folder).select("term", "tf", "df")


@query("e05_idf")
def _(spark, folder):
    return vocabulary(spark, folder).select("term", F.round("idf", 6).alias("idf"))


@query("e06_tfidf")
def _(spark, folder):
    rows = cut_lineage(terms(spark, folder).select("comment_id", "terms"), "terms")
    words = cut_lineage(features.vocabulary(rows, "terms", 2, 0.95, 30_000), "vocabulary")
    found = features.term_weights(rows, "comment_id", "terms", words)
    return found.select("comment_id", "term", F.round("weight", 6).alias("weight"))


@query("e07_constant_fill")
def _(spark, folder):
    fill = features.ConstantFill(inputCol="mm", outputCol="mm", value=0)
    return fill.transform(fixtures.comments(spark, folder)).select("comment_id", "mm")


@query("e08_min_max")
def _(spark, folder):
    rows = features.TextLength(inputCol="clean_body", outputCol="text_len").transform(prepared(spark, folder))
    rows = cut_lineage(rows.select("comment_id", "yyyy", "text_len"), "lengths")
    scaler = features.RangeScaler(inputCol="text_len", outputCol="scaled").fit(rows.filter("yyyy = 2023"))
    return scaler.transform(rows).select("comment_id", F.round("scaled", 6).alias("scaled"))


@query("e09_most_frequent_fill")
def _(spark, folder):
    rows = fixtures.comments(spark, folder).select("comment_id", "subreddit")
    return features.MostFrequentFill(inputCol="subreddit", outputCol="subreddit").fit(rows).transform(rows)


@query("e10_one_hot")
def _(spark, folder):
    rows = prepared(spark, folder).select("comment_id", "subreddit", "label")
    coded = features.OneHot(inputCol="subreddit", outputCol="hot").fit(rows.filter("label = 1 AND subreddit <> 'other'")).transform(rows)
    slots = features.vector_entries(F.col("hot"))
    return coded.select("comment_id", "subreddit", F.coalesce(F.try_element_at(slots, F.lit(1))["slot"], F.lit(-1)).alias("slot"))


def _entry_counts(spark: SparkSession, rows: DataFrame, **options) -> DataFrame:
    model = features.pipeline(**options).fit(rows)
    size = len(features.feature_names(model))
    vectors = features.featurize(model, rows)
    count = F.size(features.vector_entries(F.col("features")))
    return vectors.select("comment_id", count.alias("n_entries"), F.lit(size).alias("n_slots"))


@query("e11_assemble")
def _(spark, folder):
    return _entry_counts(spark, modelling(spark, folder))


@query("e12_variants")
def _(spark, folder):
    rows = modelling(spark, folder)
    masked = _entry_counts(spark, rows, mask=ANXIETY).withColumn("variant", F.lit("masked"))
    return masked.unionByName(_entry_counts(spark, rows, mask=None).withColumn("variant", F.lit("unmasked")))


# Models

def _binary_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    split = sample.stratified(modelling(spark, folder), 0.2, 0.2)
    train = sample.downsample(split.filter("split = 'train'").drop("split"), 3)
    return models.with_svm_folds(train), split.filter("split = 'test'").drop("split")


def _test_vectors(feature_model: PipelineModel, test: DataFrame) -> DataFrame:
    """Ids and vectors of the test rows, stored: several models read them."""
    return cut_lineage(features.featurize(feature_model, dealt(test)).select("comment_id", "features"), "test-vectors")


def _scores(spark: SparkSession, folder: str, build: models.Builder) -> DataFrame:
    train, test = _binary_parts(spark, folder)
    fitted = models.fit(train, features.pipeline(), build, 1.0, "balanced")
    return fitted.score(test).select("comment_id", "label", "score", "prediction")


@query("f01_logistic")
def _(spark, folder):
    return _scores(spark, folder, models.build_logistic)


@query("f02_calibrated_svm")
def _(spark, folder):
    return _scores(spark, folder, models.build_calibrated_svm)


@query("f03_class_weights")
def _(spark, folder):
    rows = models.with_class_weights(keys(spark, folder))
    weights = [F.round(c, 6).alias(c) for c in ("w_balanced", "w_5", "w_10")]
    return rows.select("comment_id", "label", *weights)


def _grid(spark: SparkSession, folder: str, name: str) -> DataFrame:
    train, _ = _binary_parts(spark, folder)
    found = models.grid_scores(train, features.pipeline(), {name: models.BUILDERS[name]})
    return spark.createDataFrame(found, "model_name string, c double, weighting string, mean_auc double")


@query("f04_grid_search_logistic")
def _(spark, folder):
    return _grid(spark, folder, "logistic_regression")


@query("f04_grid_search_svm")
def _(spark, folder):
    return _grid(spark, folder, "linear_svm")


@query("f05_scores")
def _(spark, folder):
    """Probability where the model has one, margin where it has only that."""
    train, test = _binary_parts(spark, folder)
    feature_model, rows, sizes = models.training_vectors(train, features.pipeline())
    tested = _test_vectors(feature_model, test)
    return evaluate.union_all([
        models.with_score(estimator.fit(rows).transform(tested)).select("comment_id", F.lit(name).alias("kind"), "score")
        for name, estimator in (("probability", models.logistic(sizes)), ("margin", models.linear_svm(sizes)))
    ])


@query("f06_best_threshold")
def _(spark, folder):
    return evaluate.best_threshold(scored(spark, folder)).select(F.round("threshold", 6).alias("threshold"))


@query("f07_apply_threshold")
def _(spark, folder):
    return scored(spark, folder).select("comment_id", "label", "prediction")


def _intensity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = levels(spark, folder).select("comment_id", "clean_body", "subreddit", F.col("intensity_label").alias("label"))
    split = cut_lineage(sample.stratified(cut_lineage(rows, "levels")), "split")
    train, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    fitted = jobs.fit_intensity(train, name)
    predicted = fitted.classifier.transform(features.featurize(fitted.features, dealt(test)))
    return predicted.select("comment_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("f08_intensity_logistic")
def _(spark, folder):
    return _intensity(spark, folder, "logistic_regression")


@query("f09_intensity_svm")
def _(spark, folder):
    return _intensity(spark, folder, "linear_svm")


@query("f10_refit_temporal")
def _(spark, folder):
    split = sample.temporal(label.with_period(modelling(spark, folder)))
    early, late = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    fitted, _ = jobs.train_binary(early, models.build_logistic, 1.0, "balanced")
    return fitted.score(late).select("comment_id", "label", "score", "prediction")


# Evaluation

@query("g01_binary_metrics")
def _(spark, folder):
    found = evaluate.binary(scored(spark, folder))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("g02_auc")
def _(spark, folder):
    return evaluate.auc(scored(spark, folder)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("g03_confusion")
def _(spark, folder):
    return evaluate.confusion(scored(spark, folder), [0, 1])


@query("g04_report")
def _(spark, folder):
    found = evaluate.intensity_report(evaluate.confusion(rated(spark, folder)))
    return found.select("class_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "support")])


@query("g05_roc_curve")
def _(spark, folder):
    points = evaluate.roc_curve(scored(spark, folder))
    return points.select(*[F.round(c, 6).alias(c) for c in points.columns])


@query("g06_pr_curve")
def _(spark, folder):
    points = evaluate.pr_curve(scored(spark, folder))
    return points.select(*[F.round(c, 6).alias(c) for c in points.columns])


@query("g07_pr_baseline")
def _(spark, folder):
    return evaluate.pr_baseline(scored(spark, folder)).select(F.round("baseline", 6).alias("baseline"))


@query("g08_mean_f1")
def _(spark, folder):
    found = evaluate.mean_f1(evaluate.confusion(rated(spark, folder)))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("g09_ordinal_mae")
def _(spark, folder):
    return evaluate.ordinal_mae(rated(spark, folder)).select(F.round("mae", 6).alias("mae"))


@query("g10_feature_importance")
def _(spark, folder):
    train, _ = _binary_parts(spark, folder)
    fitted = models.fit(train, features.pipeline(), models.build_logistic, 1.0, "balanced")
    return models.importance(fitted, spark)


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.scored(spark, folder)
    scores = evaluate.score_table(rows)
    return evaluate.union_all([
        evaluate.binary_summary(evaluate.apply_threshold(rows, t), "length", f"at_{t}", scores) for t in (0.3, 0.5, 0.7)
    ])


QUERIES["g11_summary"] = summaries


# Further lexicons and parameters

row_query(
    "x01_optimism", n_optimism=lambda: text.hits(body(), OPTIMISM_SUBSTRINGS),
    optimistic=lambda: text.any_hit(body(), OPTIMISM_SUBSTRINGS),
)
row_query(
    "x02_substring_lexicons", n_ai=lambda: text.hits(body(), AI_SUBSTRINGS),
    n_anxiety=lambda: text.hits(body(), ANXIETY_SUBSTRINGS),
)


@query("x03_year_split")
def _(spark, folder):
    return label.by_year(fixtures.comments(spark, folder)).select("comment_id", "split")


@query("x04_vocabulary_limits")
def _(spark, folder):
    return features.vocabulary(terms(spark, folder, max_tokens=200), "terms", 5, 0.95, 20_000).select("term", "tf", "df")


@query("x05_fixed_penalty")
def _(spark, folder):
    train, test = _binary_parts(spark, folder)
    feature_model, rows, sizes = models.training_vectors(train, features.pipeline())
    tested = _test_vectors(feature_model, test)
    estimators = {"logistic_regression": models.logistic(sizes), "linear_svm": models.linear_svm(sizes)}
    return evaluate.union_all([
        estimator.setRegParam(0.01).setMaxIter(100).fit(rows).transform(tested).select(
            "comment_id", F.lit(name).alias("model_name"), vector_to_array("rawPrediction")[1].alias("margin")
        )
        for name, estimator in estimators.items()
    ])


def _stage_sizes(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Rows of each stage, from the folders of the stages themselves."""
    out = new_path(spark, "job")
    found = jobs.label_job(spark, fixtures.comments(spark, folder), out)
    jobs.feature_job(spark, found, out)
    return evaluate.union_all([
        spark.read.parquet(f"{out}/{stage}/*").groupBy(F.lit(stage).alias("stage"), *keys).agg(F.count("*").alias("n"))
        for stage in ("filtered", "labelled", "features")
    ])


@query("x06_stages")
def _(spark, folder):
    return _stage_sizes(spark, folder, "label")


@query("x07_whole_stages")
def _(spark, folder):
    return _stage_sizes(spark, folder)
