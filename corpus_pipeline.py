"""The corpus pipeline: stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsignal.llm import langid, line_dedup, mixing, ngram_join, packing
from textsignal.llm.common import renamed
from textsignal.llm.queries import MIX, tokenizer
from textsignal.session import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with all their columns."""
    return langid.recognised(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those that had such lines and have nothing but white space left go."""
    plain, at = renamed(docs)
    short = line_dedup.dedup(plain, id_col=at["doc_id"], text_col=at["text"])
    short = short.filter((F.col("n_dropped") == 0) | F.col(at["text"]).rlike(r"\S"))
    if "n_chars" in at:
        kind = plain.schema[at["n_chars"]].dataType
        dropped = F.col("n_dropped") > 0
        short = short.withColumn(at["n_chars"], F.when(dropped, F.length(at["text"])).otherwise(F.col(at["n_chars"])).cast(kind))
    return short.select(plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that n-gram links hold together; of equal rows, one."""
    plain, at = renamed(docs)
    key, text = at["doc_id"], at["text"]
    found = ngram_join.join(plain, id_col=key, text_col=text)
    others = found.filter("NOT (doc_id <=> class_id)").select(F.col("doc_id").alias(key)).distinct()
    return plain.join(others, key, "left_anti").dropDuplicates([key, text]).select(plain.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped so that sources come to their target weights; copies are equal rows."""
    plain, at = renamed(docs)
    mixed = mixing.mix_sources(plain, MIX, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"])
    return mixed.select(plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]
# The classifier is trained; SQL can't state its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
