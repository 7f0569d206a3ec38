"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsignal.llm import (
    alignment, langid, line_dedup, lm, mixing, ngram_join, packing, repeats, supermin, syncmers, token_counts, topk, zones,
)

# Production parameters of the mix: the hot source gets less than its share, two get more.
MIX = {"src0": 2.0, "src1": 3.0, "src2": 3.0}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, folder, "documents"), MIX)


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(_read(spark, folder, "documents"))


def op3_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(_read(spark, folder, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; every machine has the package that holds it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer() -> str:
    return vocabulary("byte_bpe_50k.json")


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(_read(spark, folder, "documents"))


def op5_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), tokenizer())


def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.dedup(_read(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_read(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return zones.mine(_read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_texts(_read(spark, folder, "documents"), tokenizer(), vocabulary("piece_bpe_32k.model"))


def op13_super_min_hash(spark: SparkSession, folder: str) -> DataFrame:
    return supermin.near_duplicates(_read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_ngram_join, op3_lm_scores, op4_fingerprints, op5_pack, op6_top_k, op7_repeats, op8_language_id, op9_token_counts,
    op10_line_dedup, op11_hard_negatives, op12_align_tokens, op13_super_min_hash,
)}
ORACLE_SQL = {
    "op1_mix_sources": mixing.oracle_sql(MIX), "op6_top_k": topk.ORACLE_SQL, "op11_hard_negatives": zones.ORACLE_SQL,
    "op13_super_min_hash": supermin.ORACLE_SQL,
}
