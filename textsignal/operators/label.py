"""Candidate filters, weak labels, intensity levels and the rows fit for modelling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsignal.functions import text
from textsignal.functions.lexicon import (
    AI, ANXIETY, COMMUNITIES, INTENSITY_NAMES, JOB, MODERATE, SEVERE, Lexicon,
)

TIERS = ((SEVERE, 2), (MODERATE, 1))
MIN_LENGTH = 10  # characters of a text that a model may use


def with_clean_body(df: DataFrame, clean: Callable[[Column], Column] = text.clean_light) -> DataFrame:
    """Add ``clean_body``, the cleaned lower-case ``body``, computed once per row.

    A plain column would be copied into every later filter on it; the optimizer does
    not push filters through ``explode``, so the text is cleaned once.
    """
    lower = df.withColumn("_lower", F.lower("body"))
    others = [c for c in df.columns if c != "clean_body"]
    return lower.select(*others, F.explode(F.array(clean(F.col("_lower")))).alias("clean_body"))


def candidates(df: DataFrame, *themes: Lexicon, communities: Sequence[str] | None = None) -> DataFrame:
    """Rows whose light-cleaned body mentions every theme (by default AI and job)."""
    if communities is not None:
        df = df.filter(F.lower("subreddit").isin([c.lower() for c in communities]))
    df = with_clean_body(df)
    for theme in themes or (AI, JOB):
        df = df.filter(text.any_hit(F.col("clean_body"), theme))
    return df


def weak_label(df: DataFrame, lexicon: Lexicon = ANXIETY, label_text: str = "clean_body") -> DataFrame:
    """``label`` 1 where the text holds any term of the lexicon, else 0."""
    return df.withColumn("label", F.when(text.any_hit(F.col(label_text), lexicon), 1).otherwise(0))


def labelled(
    df: DataFrame, themes: Sequence[Lexicon] = (AI, JOB), lexicon: Lexicon = ANXIETY, communities: Sequence[str] | None = None
) -> DataFrame:
    """``candidates`` with ``weak_label``, from one pass over each text that finds the terms of all lists.

    Plain substring tests for each theme come first. The found terms are one array a text, behind
    an ``explode`` like the text, so that no list's test repeats the pass.
    """
    if communities is not None:
        df = df.filter(F.lower("subreddit").isin([c.lower() for c in communities]))
    clean = with_clean_body(df)
    for theme in themes:
        clean = clean.filter(text.may_hit(F.col("clean_body"), theme))
    kept = clean.columns
    terms = clean.select(*kept, F.explode(F.array(text.found_terms(F.col("clean_body"), *themes, lexicon))).alias("_terms"))
    for theme in themes:
        terms = terms.filter(text.any_of(F.col("_terms"), theme))
    return terms.select(*kept, F.when(text.any_of(F.col("_terms"), lexicon), 1).otherwise(0).alias("label"))


def with_severity(df: DataFrame, tiers: Sequence[tuple[Lexicon, int]] = TIERS, body: str = "body") -> DataFrame:
    """``severity_score`` from the raw lower-cased body, links included."""
    return df.withColumn("severity_score", text.severity(F.lower(body), tiers))


def intensity_bucket(score: Column) -> Column:
    return F.when(score == 0, 0).when(score == 1, 1).when(score <= 3, 2).otherwise(3)


def with_intensity(df: DataFrame) -> DataFrame:
    """``severity_score`` and its level ``intensity_label``, 0 to 3."""
    return with_severity(df).withColumn("intensity_label", intensity_bucket(F.col("severity_score")))


def merge_rare(
    df: DataFrame, min_rows: int = 5, label: str = "intensity_label", out: str | None = None
) -> DataFrame:
    """Move level 3 into 2, then 2 into 1, where a level has fewer than ``min_rows`` rows; ``out`` keeps the old level."""
    high = F.count_if(F.col(label) == 3)
    medium = F.count_if(F.col(label) == 2)
    high_goes = high < min_rows
    medium_goes = medium + F.when(high_goes, high).otherwise(0) < min_rows
    rule = df.agg(F.struct(high_goes.alias("high"), medium_goes.alias("medium"))).scalar()
    from_high = F.when(rule["high"], 2).otherwise(3)
    merged = F.when(F.col(label) == 3, from_high).otherwise(F.col(label))
    return df.withColumn(out or label, F.when((merged == 2) & rule["medium"], 1).otherwise(merged))


def intensity_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in INTENSITY_NAMES]), level + 1)


def community_type(col: Column, mapping: Mapping[str, Sequence[str]] = COMMUNITIES) -> Column:
    """Type of a community, any letter case; unknown and null give ``other``."""
    kind = F.lit("other")
    for name, members in reversed(mapping.items()):
        kind = F.when(F.lower(col).isin([m.lower() for m in members]), name).otherwise(kind)
    return kind


def normal_community(col: Column) -> Column:
    return F.coalesce(F.lower(col), F.lit("unknown"))


def valid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label reads as the number 0 or 1, cast to int."""
    number = F.expr(f"try_cast({label} AS double)")
    return df.filter(number.isin(0.0, 1.0)).withColumn(label, number.cast("int"))


def long_enough(df: DataFrame, col: str = "clean_body", min_length: int = MIN_LENGTH) -> DataFrame:
    return df.filter(F.length(col) >= min_length)


def prepare(df: DataFrame) -> DataFrame:
    """Modelling rows: full-cleaned text of ten characters or more, normal community."""
    return long_enough(with_clean_body(df, text.clean_full)).withColumn("subreddit", normal_community(F.col("subreddit")))


def with_period(df: DataFrame) -> DataFrame:
    """Rows with a year; year and month as int, a missing month counts as 1. A table without years has none."""
    year, month = (text.whole_number(c) if c in df.columns else F.lit(None).cast("int") for c in ("yyyy", "mm"))
    return df.filter(year.isNotNull()).withColumns(
        {"yyyy": year, "mm": F.coalesce(month, F.lit(1))}
    )


def by_year(df: DataFrame, train_year: int = 2023, test_year: int = 2024) -> DataFrame:
    """Rows of two years, marked ``train`` and ``test``."""
    return df.filter(F.col("yyyy").isin(train_year, test_year)).withColumn(
        "split", F.when(F.col("yyyy") == train_year, "train").otherwise("test")
    )
