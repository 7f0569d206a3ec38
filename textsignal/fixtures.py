"""A comment table derived from the ``documents`` table.

Each document gets one phrase by its id, so that every rule of the engine meets
rows it applies to. Used by the registered queries, tests and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The phrase for doc_id % 24.
PHRASES = (
    "AI will replace my job and I am worried",
    "AI and automation are changing jobs",
    "I am not worried about AI taking my job",
    "panic about ChatGPT layoffs, totally hopeless",
    "the AI job market feels overwhelmed",
    "Do not fear, or dont  worry: machine learning is good for your career",
    "see http://example.com/panic?x=1 about AI careers",
    "anxious and scared and stressed about LLMs and work",
    "no news about my job here",
    "generative AI is great",
    "the weather is nice",
    "AI hiring www.example.com slowed and people fear uncertainty",
    "AI can help workers upskill",
    "our career page lists machine learning roles",
    "AI tools save time at work",
    "a large language model wrote my job advert",
    "ChatGPT cannot replace a professional",
    "LLM skills for the future of work",
    "automation and employment in 2024",
    "GPT at work",
    "hiring for AI jobs",
    "AI, reskill and adapt",
    "artificial intelligence as a profession",
    "AI will not replace workers",
)
# The community for doc_id % 11; the last one is null.
NAMES = (
    "jobs", "careerguidance", "unemployment", "MachineLearning", "openai", "datascience",
    "mentalhealth", "Anxiety", "depression", "Other", None,
)

# What stands for each letter where comments are written in other scripts: accented, full-width, composed and
# presentation forms, ligatures, and a vowel sign, which parts words.
SCRIPTS = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    "\u03ac", "\u0439", "\ud55c", "\uff44", "\u1f04", "\ufb01", "\u304c", "\u093f", "\u0958", "\u01f0", "\u045c", "\u0142", "\u2177",
    "\u00f1", "\u1ed1", "\ufe8f", "\u3231", "\u0159", "\u1e9b", "\u0e17", "\u01d6", "\u00bd", "\u0175", "\ufb03", "\u00fd", "\uff5a",
), strict=True))


def comments_sql(table: str = "documents") -> str:
    """The comment view as SQL text that Spark and DuckDB both run."""
    phrase = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))
    name = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES) if n)
    dated = "doc_id % 50 <> 49"
    early = "doc_id % 14 < 7"
    return f"""SELECT doc_id AS comment_id,
  concat(text, ' ', CASE doc_id % 24 {phrase} END) AS body,
  CASE doc_id % 11 {name} END AS subreddit,
  CASE WHEN {dated} THEN CASE WHEN {early} THEN 2023 ELSE 2024 END END AS yyyy,
  CASE WHEN {dated} THEN CAST(CASE WHEN {early} THEN 6 + doc_id % 14 ELSE doc_id % 14 - 6 END AS int) END AS mm
FROM {table}"""


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """The view over the documents of a folder.

    The given tables are one Parquet row group each, which is one task. So their rows are dealt out
    to ``spark.sql.shuffle.partitions`` tasks, at every size. ``read_comments`` does so on demand only.
    """
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id"
    )
    return spark.sql(comments_sql("{documents}"), documents=documents)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Document quality with the document's length as its score."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("comment_id"),
        F.col("quality").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"),
    )
