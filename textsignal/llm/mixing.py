"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsignal.llm.common import renamed
from textsignal.sources.tables import cut_lineage

MOST = 1 - 1e-12  # of the uniform number: rounded sums of the distribution function may never get beyond it
MEAN = 500.0  # a larger mean is dealt with as a sum of independent parts: exp(-mean) must not vanish


def _digits(*parts: Column, n: int) -> Column:
    """The first n hexadecimal digits of the md5 of the joined parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, n), 16, 10).cast("long")


def poisson(uniform: Column, mean: Column) -> Column:
    """The Poisson count whose distribution function first exceeds ``uniform``, for means up to ``MEAN``.

    The sum over the distribution function runs to twelve standard deviations and 60 more,
    beyond what a number up to ``MOST`` can reach.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 60).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("cdf"), F.lit(0).alias("n"))

    def step(at: Column, k: Column) -> Column:
        p = at["p"] * mean / k
        return F.struct(
            p.alias("p"), (at["cdf"] + p).alias("cdf"),
            (at["n"] + F.when(at["cdf"] <= uniform, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda at: at["n"])


def rates(docs: DataFrame, source: str, size: Column, weights: Mapping[str, float], default_weight: float,
          epochs: float) -> DataFrame:
    """``source, rate``: mean repetitions of a document so that each source gets its share of the size.

    The shares are the weights, normalised over the sources present. One map-side sum; one
    row per source.
    """
    by_source = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    named = by_source[F.col("source")] if weights else F.lit(None)
    sizes = cut_lineage(
        docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum(size).alias("size"))
        .withColumn("weight", F.coalesce(named.cast("double"), F.lit(float(default_weight)))), "source-sizes",
    )
    total, weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(weight or 1.0)
    return sizes.select("source", (F.lit(epochs) * share * F.lit(float(total or 0)) / F.col("size")).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float], *, default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Each document repeated by a Poisson count, in one global random order.

    The mean of the count is the rate at which the source's bytes come to its share of
    ``epochs`` times the corpus. A document's size is its UTF-8 bytes and one for its end,
    so sources of empty texts have a size too. The count inverts the Poisson distribution at
    a number hashed from seed and id: it doesn't depend on the layout, and a lost task is
    redone alike.

    Returns all columns, ``copy`` (from 0) and ``shuffle_key``; columns of those names are
    replaced. Rows are dealt by the key and sorted by it within partitions.
    Null id: counts as the text "null". Null source: a source of its own. Null text: size 1.
    Rows with the same id get the same count. Weight 0 drops the source. Empty table: no rows.
    The rates have a row per source and are read back from a table, so that Spark
    broadcasts them only below its size limit; beyond it, skewed sources are split by AQE.
    """
    plain, at = renamed(docs)
    key, text, source = (F.col(at[c]) for c in (id_col, text_col, source_col))
    size = F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1
    table = cut_lineage(
        rates(plain, at[source_col], size, weights, default_weight, epochs)
        .select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), F.col("rate").alias("_rate")),
        "source-rates",
    )
    ident = F.coalesce(key.cast("string"), F.lit("null"))
    parts = F.greatest(F.ceil(F.col("_rate") / MEAN), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(0), parts - 1), F.lit(0),
        lambda n, i: n + poisson(
            F.least(_digits(F.lit(str(seed)), ident, i.cast("string"), n=13) / F.lit(2.0 ** 52), F.lit(MOST)), F.col("_rate") / parts
        ),
    )
    copies = (
        plain.withColumn("_source", F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")))
        .join(table, "_source").withColumn("_n", F.when(F.col("_rate") > 0, drawn).otherwise(0)).filter("_n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("shuffle_key", _digits(F.lit(f"{seed}:order"), ident, F.col("copy").cast("string"), n=15))
    )
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("copy", "shuffle_key")]
    return (
        copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*kept, "copy", "shuffle_key")
    )


def oracle_sql(weights: Mapping[str, float], seed: int = 17) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {w!r}::DOUBLE" for s, w in weights.items())
    return f"""WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS size,
    CASE source {cases} ELSE 1.0::DOUBLE END AS weight
  FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE * (weight / (SELECT sum(weight) FROM sizes)) * CAST((SELECT sum(size) FROM sizes) AS DOUBLE) / size AS rate
  FROM sizes
), steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps
  WHERE k < ceil(rate + 12 * sqrt(rate) + 60) - 1
), drawn AS (
  SELECT *, least(CAST(concat('0x', substr(md5(concat('{seed}:', doc_id, ':0')), 1, 13)) AS BIGINT) / pow(2.0::DOUBLE, 52), {MOST!r}::DOUBLE) AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, count(s.k) AS n
  FROM drawn d LEFT JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u GROUP BY d.doc_id
), copies AS (
  SELECT d.*, CAST(unnest(range(n)) AS INTEGER) AS copy FROM documents d JOIN counted USING (doc_id)
)
SELECT *, CAST(concat('0x', substr(md5(concat('{seed}:order:', doc_id, ':', copy)), 1, 15)) AS BIGINT) AS shuffle_key FROM copies"""
