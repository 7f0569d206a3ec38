"""Counts that describe a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.functions import text
from textsignal.functions.lexicon import ANXIETY, Lexicon
from textsignal.operators.label import MIN_LENGTH, intensity_name, normal_community


def row_kinds(labelled: DataFrame, lexicon: Lexicon = ANXIETY) -> DataFrame:
    """Rows of a labelled table by kind, in one scan and one shuffle: a row for each community, label and flag.

    ``subreddit`` as it stands, its normal form ``community``, the valid ``label`` or null, ``single`` for texts
    with exactly one term, ``usable`` for rows that a model may use, and their number ``n``.
    """
    number = F.expr("try_cast(label AS double)")
    lower = F.lower("body")
    return labelled.select(
        "subreddit", normal_community(F.col("subreddit")).alias("community"), F.when(number.isin(0.0, 1.0), number.cast("int")).alias("label"),
        (text.hits(lower, lexicon) == 1).alias("single"), (F.length(text.clean_full(lower)) >= MIN_LENGTH).alias("usable"),
    ).groupBy("subreddit", "community", "label", "single", "usable").agg(F.count("*").alias("n"))


def from_kinds(kinds: DataFrame) -> dict[str, DataFrame]:
    """The profiles of a labelled table, each from the few rows of ``row_kinds``."""
    valid = kinds.filter("label IS NOT NULL")
    rows = valid.filter("usable")

    def number(condition=None):
        n = F.col("n") if condition is None else F.when(condition, F.col("n")).otherwise(0)
        return F.coalesce(F.sum(n), F.lit(0))

    def by(df: DataFrame, **keys: str) -> DataFrame:
        return df.groupBy(*[F.col(c).alias(name) for name, c in keys.items()]).agg(number().alias("count"))

    positive = F.col("label") == 1
    return {
        "pool_size": kinds.agg(number().alias("n_candidates")),
        "community_distribution": by(kinds, subreddit="subreddit"),
        "label_distribution": by(rows, label="label"),
        "label_distribution_by_subreddit": by(rows, subreddit="community", label="label"),
        "label_quality": _with_share(valid.agg(number(positive).alias("n_positive"), number(positive & F.col("single")).alias("n_single"))),
        "positive_check": _with_rate(rows.agg(number().alias("n_rows"), number(positive).alias("n_positive"))),
    }


def pool_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_candidates"))


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per value of the keys, pre-aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def intensity_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy(F.col("intensity_label").alias("label_id")).agg(F.count("*").alias("count"))
    return counts.select(intensity_name(F.col("label_id")).alias("intensity"), "label_id", "count").orderBy("label_id")


def label_quality(df: DataFrame, lexicon: Lexicon = ANXIETY) -> DataFrame:
    """Positives, and the whole percent of them that rest on exactly one term."""
    positive = F.col("label") == 1
    single = positive & (text.hits(F.lower("body"), lexicon) == 1)
    return _with_share(df.agg(F.count_if(positive).alias("n_positive"), F.count_if(single).alias("n_single")))


def _with_share(counts: DataFrame) -> DataFrame:
    return counts.withColumn(
        "single_pct",
        F.bround(100.0 * F.col("n_single") / F.greatest("n_positive", F.lit(1)), 0).cast("long"),
    )


def positive_check(df: DataFrame, enough: int = 200) -> DataFrame:
    """Positives and their rate, with a flag when they are too few."""
    return _with_rate(df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_positive")), enough)


def _with_rate(counts: DataFrame, enough: int = 200) -> DataFrame:
    return counts.select(
        "n_rows", "n_positive",
        F.try_divide(100.0 * F.col("n_positive"), F.col("n_rows")).alias("positive_pct"),
        (F.col("n_positive") < enough).alias("low_positive"),
    )


def class_summary(df: DataFrame, label: str) -> DataFrame:
    """Active classes in order, and the size of the smallest one."""
    return distribution(df, label).agg(
        F.array_sort(F.collect_set(label)).alias("classes"), F.min("count").alias("smallest")
    )


def split_audit(df: DataFrame, small: int = 500) -> DataFrame:
    """Rows, positives and negatives per split; flags a training part below ``small`` rows."""
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(F.col("label") == 0).alias("n_negative"),
    ).withColumn("small_train", (F.col("split") == "train") & (F.col("n_rows") < small))
