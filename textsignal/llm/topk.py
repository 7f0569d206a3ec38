"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.llm.common import pick

ROWS = 8192  # candidates in a block
QUERIES = 4096  # queries in a block: candidates are copied once for each
SLICE = 256  # queries whose scores are dense rows at a time


def weights(vector: Column, scale: int) -> Column:
    """Each component times the scale, rounded down; null where the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(rows: pa.Table, dims: int) -> np.ndarray:
    """Vectors as rows; a shorter vector has zeros behind its end."""
    column = rows.column("w").combine_chunks()
    length = np.asarray(column.value_lengths(), np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(length), dims), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = np.asarray(column.flatten(), np.int64)
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, one dimension after another.

    A dimension's postings are the candidates with a weight there. Each query with a
    weight there scatters weighted postings into its dense row of scores.
    """
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        asking, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if len(posting) == len(candidates):
            scores[asking] += queries[asking, term, None] * candidates[None, :, term]
        elif len(asking) and len(posting):
            scores[np.ix_(asking, posting)] += queries[asking, term, None] * candidates[None, posting, term]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores of a row, ties to the smaller id, without the query's own id."""
    others = np.flatnonzero(ids != own)
    if len(others) > k:
        least = -np.partition(-scores[others], k - 1)[k - 1]
        others = others[scores[others] >= least]
    return others[np.lexsort((ids[others], -scores[others]))][:k]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k best candidates of every query by integer inner product: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on the column ``vec_id``. Every row is a candidate, but not for
    queries of its own id. Components become floor(scale * x). Blocks of queries meet blocks of
    candidates, some queries at a time; each pair of blocks keeps k candidates a query, and a window, cut to k rows
    before its shuffle, merges them. Blocks have a fixed size, so a task's memory doesn't grow.
    Null ids, null vectors and vectors with null or non-finite components take no part; a
    vector without components scores 0. Equal rows are candidates each for itself, and one
    query; rows that share an id but not their vector are queries of their own. Missing
    dimensions of a shorter vector count as 0. Empty table: no rows.
    """
    rows = pick(vectors, vec_id=id_col, vector=vector_col).select(
        F.col("vec_id").cast("long"), weights(F.col("vector"), scale).alias("w")
    ).filter("vec_id IS NOT NULL AND w IS NOT NULL")
    asked = rows.filter(is_query).distinct().withColumn("asked", F.xxhash64("w"))
    n, n_asked = rows.count(), asked.count()
    blocks, sheets = max(1, -(-n // ROWS)), max(1, -(-n_asked // QUERIES))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(own_n)).cast("int")
        return df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    def best(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(candidates) and len(queries):
            dims = max(max(t.column("w").combine_chunks().value_lengths().to_pylist()) for t in (candidates, queries))
            ids, asking = (np.asarray(t.column("vec_id").combine_chunks(), np.int64) for t in (candidates, queries))
            mark = np.asarray(queries.column("asked").combine_chunks(), np.int64)
            left, right = _matrix(queries, dims), _matrix(candidates, dims)
            for low in range(0, len(asking), SLICE):
                table = accumulate(left[low:low + SLICE], right)
                for i, own in enumerate(asking[low:low + SLICE]):
                    places = select(table[i], ids, own, k)
                    out.append((np.full(len(places), own), np.full(len(places), mark[low + i]), ids[places], table[i][places]))
        columns = [np.concatenate(c).astype(np.int64) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [[]] * 4)]
        return pa.table(dict(zip(("query_id", "asked", "vec_id", "score"), columns)))

    pairs = (
        dealt(rows, "block", blocks, "sheet", sheets).groupBy("block", "sheet")
        .cogroup(dealt(asked, "sheet", sheets, "block", blocks).groupBy("block", "sheet"))
        .applyInArrow(best, "query_id long, asked long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


ORACLE_SQL = """WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, len(q.w) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10"""
