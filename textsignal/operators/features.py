"""Feature stages: TF-IDF over words and bigrams, scaled text length, community one-hot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, OneHotEncoder, SQLTransformer,
    StringIndexerModel, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions import text
from textsignal.functions.lexicon import ANXIETY, STOP_WORDS, Lexicon
from textsignal.sources.tables import cut_lineage, dealt


class _Stage(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage with one input column, one output column and keyword parameters."""

    @keyword_only
    def __init__(self, **params):
        super().__init__()
        self._set(**self._input_kwargs)


class KeywordMasker(_Stage, Transformer):
    """Blank out whole words of a list, so that the label's own words are no features."""

    terms = Param(Params._dummy(), "terms", "words to remove", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        words = Lexicon("mask", tuple(self.getOrDefault(self.terms)))
        return df.withColumn(self.getOutputCol(), text.mask(F.col(self.getInputCol()), words))


class TextLength(_Stage, Transformer):
    """Characters of a text; null counts 0."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), text.text_length(F.col(self.getInputCol())))


class WordExtractor(_Stage, Transformer):
    """Words of two or more characters without stop words."""

    stopWords = Param(Params._dummy(), "stopWords", "words to drop", TypeConverters.toListString)
    maxTokens = Param(Params._dummy(), "maxTokens", "tokens used per text, 0 for all", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        words = text.tokens(F.col(self.getInputCol()))
        if self.getOrDefault(self.maxTokens):
            words = F.slice(words, 1, self.getOrDefault(self.maxTokens))
        return df.withColumn(self.getOutputCol(), text.drop_words(words, self.getOrDefault(self.stopWords)))


class WordPairs(_Stage, Transformer):
    """Words followed by their bigrams: three times the words' bytes, so they are made where they are read and not stored."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), text.with_bigrams(F.col(self.getInputCol())))


class TermExtractor(WordExtractor):
    """Words of two or more characters without stop words, followed by their bigrams."""

    def _transform(self, df: DataFrame) -> DataFrame:
        words = self.copy({self.outputCol: "_words"})
        return WordPairs(inputCol="_words", outputCol=self.getOutputCol()).transform(WordExtractor._transform(words, df)).drop("_words")


def term_counts(df: DataFrame, terms: str, fold: str | None = None, n_folds: int = 0) -> DataFrame:
    """``term, tf, df``: occurrences and texts per term, in one pass and one shuffle; the null term counts all texts.

    With a fold column also ``tf_<k>, df_<k>`` of each fold's own texts, from the same pass. A text's terms are sorted, so
    each is one row that tells by the term before it whether it is the text's first such; the null after the last is the text itself.
    """
    place = [F.col(fold).alias("_fold")] if fold else []
    ordered = df.select(*place, F.sort_array(terms).alias("_terms"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("_terms"))
    rows = ordered.select(*place and ["_fold"], F.inline(F.arrays_zip(F.col("_terms").alias("term"), before.alias("before"))))
    kinds = {"tf": F.col("term").isNotNull(), "df": F.col("term").isNull() | ~F.col("term").eqNullSafe(F.col("before"))}
    sums = [F.count_if(of).alias(c) for c, of in kinds.items()]
    for k in range(n_folds):
        sums += [F.count_if((F.col("_fold") == k) & of).alias(f"{c}_{k}") for c, of in kinds.items()]
    return rows.groupBy("term").agg(*sums)


def limited(counts: DataFrame, min_df: int, max_df: float, size: int, without: int | None = None) -> DataFrame:
    """``term, tf, df, idf`` of the ``size`` most frequent terms within the text-frequency limits, from stored counts.

    ``without`` takes a fold's own counts off, so all folds' vocabularies come from one count.
    The smoothed idf is ``ln((1 + n) / (1 + df)) + 1``; the number of texts n is the counts' own null term.
    """
    if without is not None:
        counts = counts.select("term", *[(F.col(c) - F.col(f"{c}_{without}")).alias(c) for c in ("tf", "df")]).filter("df > 0")
    n = F.coalesce(counts.filter("term IS NULL").select("df").scalar(), F.lit(0))
    inside = F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= max_df * n)
    found = counts.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1).filter(inside)
    return found.select("term", "tf", "df", "idf").orderBy(F.desc("tf"), "term").limit(size)


def vocabulary(df: DataFrame, terms: str, min_df: int, max_df: float, size: int) -> DataFrame:
    """``term, tf, df, idf`` of the ``size`` most frequent terms within the text-frequency limits, ties in term order.

    The counts, a row per term, are stored: the texts are read once.
    """
    return limited(cut_lineage(term_counts(df, terms), "term-counts"), min_df, max_df, size)


def term_weights(df: DataFrame, key: str, terms: str, words: DataFrame) -> DataFrame:
    """``key, term, weight``: the L2-normal TF-IDF entries of each text as rows, over the terms of a vocabulary.

    Texts are placed by key once, as arrays; their terms meet the vocabulary, whose size is bounded,
    before they are counted, and counts and norms of a key stay where it is.
    """
    placed = df.select(key, terms).repartition(key)
    met = placed.select(key, F.explode(terms).alias("term")).join(F.broadcast(words.select("term", "idf")), "term")
    raw = met.groupBy(key, "term", "idf").agg((F.count("*") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


class TermWeights(_Stage, Estimator):
    """L2-normal TF-IDF with smoothed idf ``ln((1 + n) / (1 + df)) + 1``.

    The vocabulary reaches the driver; ``size`` bounds it.
    """

    minDF = Param(Params._dummy(), "minDF", "smallest number of texts", TypeConverters.toInt)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of texts", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "largest vocabulary", TypeConverters.toInt)

    def _fit(self, df: DataFrame) -> PipelineModel:
        return self._model(vocabulary(df, self.getInputCol(), *self._limits()))

    def fit_folds(self, df: DataFrame, fold: str, n: int) -> list[PipelineModel]:
        counts = cut_lineage(term_counts(df, self.getInputCol(), fold, n), "fold-term-counts")
        return [self._model(limited(counts, *self._limits(), without=k)) for k in range(n)]

    def _limits(self) -> list:
        return [self.getOrDefault(p) for p in (self.minDF, self.maxDF, self.size)]

    def _model(self, words: DataFrame) -> PipelineModel:
        found = words.collect()
        if not found:
            raise ValueError("empty vocabulary: no term is within the text-frequency limits")
        out = self.getOutputCol()
        counter = CountVectorizerModel.from_vocabulary(
            [row["term"] for row in found], inputCol=self.getInputCol(), outputCol=f"_{out}_tf"
        )
        weigher = ElementwiseProduct(scalingVec=Vectors.dense([row["idf"] for row in found]), inputCol=f"_{out}_tf", outputCol=f"_{out}_idf")
        return PipelineModel(stages=[counter, weigher, Normalizer(p=2.0, inputCol=f"_{out}_idf", outputCol=out)])


class RangeScaler(_Stage, Estimator):
    """Min-max scaling fitted on the training rows, not clipped; a constant column gives 0."""

    def _fit(self, df: DataFrame) -> SQLTransformer:
        return self._model([df.agg(F.min(self.getInputCol()), F.max(self.getInputCol())).first()])

    def fit_folds(self, df: DataFrame, fold: str, n: int) -> list[SQLTransformer]:
        col = self.getInputCol()
        ends = {r[0]: r[1:] for r in df.groupBy(fold).agg(F.min(col), F.max(col)).collect()}
        return [self._model([e for f, e in ends.items() if f != k]) for k in range(n)]

    def _model(self, ends: Sequence[Sequence]) -> SQLTransformer:
        col, out = self.getInputCol(), self.getOutputCol()
        low = min((a for a, _ in ends if a is not None), default=None)
        high = max((b for _, b in ends if b is not None), default=None)
        low, width = low or 0, ((high or 0) - (low or 0)) or 1
        scaled = f"(coalesce({col}, 0) - {low}) / CAST({width} AS double) AS {out}"
        return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """The most frequent value of a column, ties in value order; nulls do not count."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), col).limit(1).select(F.col(col).alias("value"))


class ConstantFill(_Stage, Transformer):
    """Replace nulls by one value."""

    value = Param(Params._dummy(), "value", "value for nulls", TypeConverters.identity)

    def _transform(self, df: DataFrame) -> DataFrame:
        filled = F.coalesce(F.col(self.getInputCol()), F.lit(self.getOrDefault(self.value)))
        return df.withColumn(self.getOutputCol(), filled)


class MostFrequentFill(_Stage, Estimator):
    """Replace nulls by the most frequent value of the training rows."""

    def _fit(self, df: DataFrame) -> ConstantFill:
        found = most_frequent(df, self.getInputCol()).first()
        value = found["value"] if found else ""
        return ConstantFill(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), value=value)


class OneHot(_Stage, Estimator):
    """Nulls filled with the most frequent value, then a one-hot column over the values in order; an unseen value gives all zeros.

    ``largest`` keeps that many of the most frequent values, by an exact count, ties in value order;
    others give all zeros, too. 0, the default, keeps all. The kept values reach the driver.
    """

    largest = Param(Params._dummy(), "largest", "values kept, 0 for all", TypeConverters.toInt)

    def _fit(self, df: DataFrame) -> PipelineModel:
        return self._model(df, df.groupBy(F.col(self.getInputCol()).alias("value")).agg(F.count("*").alias("n")))

    def fit_folds(self, df: DataFrame, fold: str, n: int) -> list[PipelineModel]:
        own = [F.count_if(F.col(fold) == k).alias(f"n_{k}") for k in range(n)]
        counts = cut_lineage(df.groupBy(F.col(self.getInputCol()).alias("value")).agg(F.count("*").alias("n"), *own), "fold-values")
        return [self._model(df, counts.select("value", (F.col("n") - F.col(f"n_{k}")).alias("n"))) for k in range(n)]

    def _model(self, df: DataFrame, counts: DataFrame) -> PipelineModel:
        counts = counts.filter("value IS NOT NULL AND n > 0").orderBy(F.desc("n"), "value")
        if self.isDefined(self.largest) and self.getOrDefault(self.largest):
            counts = counts.limit(self.getOrDefault(self.largest))
        names = [r["value"] for r in counts.collect()] or [""]
        filled, place = f"_{self.getOutputCol()}_filled", f"_{self.getOutputCol()}_id"
        fill = ConstantFill(inputCol=self.getInputCol(), outputCol=filled, value=names[0])
        index = StringIndexerModel.from_labels(sorted(names), inputCol=filled, outputCol=place, handleInvalid="keep")
        # the encoder reads the number of values from the index column's metadata
        hot = OneHotEncoder(inputCol=place, outputCol=self.getOutputCol(), dropLast=True).fit(index.transform(fill.transform(df)))
        return PipelineModel(stages=[fill, index, hot])


def default_stop_words() -> list[str]:
    return list(STOP_WORDS)


def pipeline(
    mask: Lexicon | None = ANXIETY, stop_words: Sequence[str] | None = None, min_df: int = 2,
    max_df: float = 0.95, size: int = 30_000, max_tokens: int = 0,
    body: str = "clean_body", community: str = "subreddit", max_communities: int = 0,
) -> Pipeline:
    """Stages from text and community to the ``features`` vector.

    ``mask`` blanks the label's words out of the text (binary model); None keeps them
    (intensity model). ``max_communities`` keeps the most frequent communities only, 0 all.
    """
    words = list(stop_words) if stop_words is not None else default_stop_words()
    shown, stages = body, []
    if mask is not None:
        shown = "_masked"
        stages.append(KeywordMasker(inputCol=body, outputCol=shown, terms=list(mask.terms)))
    stages += [
        WordExtractor(inputCol=shown, outputCol="_words", stopWords=words, maxTokens=max_tokens),
        WordPairs(inputCol="_words", outputCol="_terms"),
        TermWeights(inputCol="_terms", outputCol="_text", minDF=min_df, maxDF=max_df, size=size),
        TextLength(inputCol=body, outputCol="_length"),
        RangeScaler(inputCol="_length", outputCol="_text_len"),
        OneHot(inputCol=community, outputCol="_community_hot", largest=max_communities),
        VectorAssembler(inputCols=["_text", "_text_len", "_community_hot"], outputCol="features"),
    ]
    return Pipeline(stages=stages)


def featurize(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The input columns and ``features``, without the columns in between.

    The vector's slot names are left out of the schema: they would be sent with every
    task of every iteration of a fit.
    """
    return model.transform(df).select(*df.columns, F.col("features").alias("features", metadata={}))


def _prepared(pipeline: Pipeline, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list, list]:
    """The columns ``keep`` and what the estimators read, stored; the stages that need no fit and made it; and the other stages.

    Texts become words here, once and in even tasks, however often the stored rows are read; pairs of words are made by each reader.
    """
    first, rest = [], []
    shared = dealt(df)
    for stage in pipeline.getStages():
        if isinstance(stage, Transformer) and not isinstance(stage, WordPairs) and set(_inputs(stage)) <= set(shared.columns):
            shared = stage.transform(shared)
            first.append(stage)
        else:
            rest.append(stage)
    read = {c for stage in rest for c in _inputs(stage)}
    kept = dict.fromkeys([*keep, *(c for c in shared.columns if c in read)])
    return cut_lineage(shared.select(*kept), "prepared"), first, rest


def _fitted(rest: Sequence, rows: DataFrame, fit: Callable) -> list:
    """Each of the stages as it is, or fitted on the rows with the pairs of their words."""
    made = []
    for stage in rest:
        made.append(fit(stage, rows) if isinstance(stage, Estimator) else stage)
        rows = stage.transform(rows) if isinstance(stage, WordPairs) else rows
    return made


def fit_stored(pipeline: Pipeline, df: DataFrame, keep: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame, PipelineModel]:
    """The fitted pipeline; the stored rows it was fitted on, with ``keep``; and the part of it that makes their vectors.

    Counts, ranges and vectors all read the stored rows, so a text is split into words once and not for each.
    """
    rows, first, rest = _prepared(pipeline, df, keep)
    made = _fitted(rest, rows, lambda stage, df: stage.fit(df))
    return PipelineModel(stages=[*first, *made]), rows, PipelineModel(stages=made)


def fit_folds(pipeline: Pipeline, df: DataFrame, fold: str, n: int, keep: Sequence[str] = ()) -> tuple[DataFrame, list[PipelineModel]]:
    """The pipeline fitted for each fold on the rows outside it, without a pass over the texts for each.

    Stages that need no fit run once, as long as their input is there, and what the others read is stored with
    ``keep``. Each estimator then counts once by fold; a fold's model comes from all counts less its own.
    Returns the stored rows and a model for each fold over them.
    """
    shared, _, rest = _prepared(pipeline, df, [fold, *keep])
    made = _fitted(rest, shared, lambda stage, df: stage.fit_folds(df, fold, n))
    return shared, [PipelineModel(stages=[m[k] if isinstance(m, list) else m for m in made]) for k in range(n)]


def _inputs(stage) -> list[str]:
    return stage.getInputCols() if isinstance(stage, HasInputCols) else [stage.getInputCol()]


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the ``features`` slots, in order."""
    parts = [part for stage in model.stages if isinstance(stage, PipelineModel) for part in stage.stages]
    terms = next(p for p in parts if isinstance(p, CountVectorizerModel)).vocabulary
    communities = next(p for p in parts if isinstance(p, StringIndexerModel)).labels
    return [f"text__{t}" for t in terms] + ["meta__text_len"] + [f"subreddit__x0_{c}" for c in communities]


def vector_entries(col: Column) -> Column:
    """Non-zero ``(slot, value)`` pairs of a vector column, from its slots and values."""
    vector = F.unwrap_udt(col)
    slots = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    pairs = F.arrays_zip(slots.alias("slot"), vector["values"].alias("value"))
    return F.filter(pairs, lambda e: e["value"] != 0)
