"""Jaccard self-join on word n-grams: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

from fractions import Fraction
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.llm.common import LOWER, chunks, hashed_words, joined, mix, pick
from textsignal.llm.components import components
from textsignal.sources.tables import cut_lineage

N = 5  # words of an n-gram
THRESHOLD = 0.8
RECALL = 0.9999  # of a pair at the threshold
HASHES = 80  # at most, in all bands
BLOCK = 1 << 16  # n-grams of the texts that are compared as one block
WIDTH = 4096  # n-grams multiplied at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)


def bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Number of bands and rows of each: the most rows, which let fewest other pairs through, at the target recall.

    A pair of similarity s shares a band of r rows with probability s**r.
    """
    best = None
    for rows in range(1, hashes + 1):
        share = threshold ** rows
        n = ceil(log(1 - recall) / log(1 - share)) if share > 1e-9 else hashes + 1
        if n * rows <= hashes:
            best = n, rows
    if best is None:
        raise ValueError(f"{hashes} hashes don't reach a recall of {recall}")
    return best


def grams(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and the places where the texts' hashes start and end.

    Words are split at ASCII white space, A-Z in lower case. A text of fewer than n words has one gram
    of all its words; a text without words has none.
    """
    word, edge = hashed_words(LOWER[data], at)
    size = np.diff(edge)
    doc = np.repeat(np.arange(len(size)), size)
    made, owner = [], []
    if len(word) >= n:
        h = word[:len(word) - n + 1].copy()
        for i in range(1, n):
            h = h * _STEP + word[i:len(word) - n + 1 + i]
        whole = doc[:len(h)] == doc[n - 1:]
        made.append(mix(h[whole]))
        owner.append(doc[:len(h)][whole])
    for i in np.flatnonzero((size > 0) & (size < n)):
        h = np.uint64(size[i])
        with np.errstate(over="ignore"):
            for w in word[edge[i]:edge[i + 1]]:
                h = h * _STEP + w
        made.append(mix(np.array([h])))
        owner.append(np.array([i]))
    if not made:
        return np.zeros(0, np.uint64), np.zeros(len(size) + 1, np.int64)
    made, owner = np.concatenate(made), np.concatenate(owner)
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    return made[new], np.searchsorted(owner[new], np.arange(len(size) + 1))


def set_hashes(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of each set of n-grams; 0 for the empty set."""
    out = np.zeros(len(at) - 1, np.uint64)
    filled = np.flatnonzero(at[1:] > at[:-1])
    if len(filled):
        out[filled] = mix(np.add.reduceat(mix(gram ^ _STEP), at[:-1][filled]) + np.diff(at)[filled].astype(np.uint64))
    return out.view(np.int64)


def band_hashes(gram: np.ndarray, at: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """MinHash values of each non-empty set, hashed together by band; a hash names its band, too."""
    rng = np.random.default_rng(0)
    flips = rng.integers(0, 1 << 32, n_bands * rows, np.uint32)
    factors = rng.integers(0, 1 << 31, n_bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
    filled = np.flatnonzero(at[1:] > at[:-1])
    short, starts = (gram >> np.uint64(32)).astype(np.uint32), at[:-1][filled]
    out = np.zeros((len(filled), n_bands), np.uint64)
    for i in range(n_bands * rows if len(filled) else 0):
        least = np.minimum.reduceat((short ^ flips[i]) * factors[i], starts)
        out[:, i // rows] = mix(out[:, i // rows] * _STEP + least + np.uint64(i + 1))
    return out.view(np.int64)


def signatures(docs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """``key, cls, size, bands``: hash of a text's n-gram set, its size and its bands."""

    def run(batches):
        for b in batches:
            data, at = joined(b.column("text"))
            for low, high in chunks(at):
                gram, edge = grams(data[at[low]:at[high]], at[low:high + 1] - at[low])
                values = band_hashes(gram, edge, n_bands, rows)
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum((np.diff(edge) > 0) * n_bands)]).astype(np.int32), pa.array(values.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").slice(low, high - low), pa.array(set_hashes(gram, edge)), pa.array(np.diff(edge)), lists],
                    ["key", "cls", "size", "bands"],
                )

    return docs.mapInArrow(run, "key long, cls long, size long, bands array<long>")


def overlaps(gram: np.ndarray, at: np.ndarray, split: int | None = None) -> np.ndarray:
    """Sizes of the intersections: of all sets, or of the first ``split`` with the others."""
    n = len(at) - 1
    left, right = (slice(0, n),) * 2 if split is None else (slice(0, split), slice(split, n))
    out = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    owner = np.repeat(np.arange(n), np.diff(at))
    _, column, count = np.unique(gram, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.searchsorted(column, np.arange(0, len(shared) + WIDTH, WIDTH))
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        x = np.zeros((n, min(WIDTH, len(shared) - i * WIDTH)), np.float32)
        x[owner[low:high], column[low:high] - i * WIDTH] = 1
        out += x[left] @ x[right].T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest place in the component of each place."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(root)).min(1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: Fraction):
    up, down = threshold.numerator, threshold.denominator

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("cls", "ascending")])
        side, cls, copies = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("side", "cls", "copies"))
        gram, at = grams(*joined(rows.column("text")))
        own = set_hashes(gram, at) == cls  # a repeated id may bring other texts along
        own[1:] &= (cls[1:] != cls[:-1]) | (side[1:] != side[:-1])
        if not own.all():
            gram, at = gram[np.repeat(own, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at)[own])])
            side, cls, copies = side[own], cls[own], copies[own]
        size, split = np.diff(at), int((side == 0).sum())
        n = len(size)
        linked = np.zeros((n, n), bool)
        if split == n:
            linked = overlaps(gram, at) * (up + down) >= up * (size[:, None] + size[None, :])
            np.fill_diagonal(linked, False)
        else:
            linked[:split, split:] = overlaps(gram, at, split) * (up + down) >= up * (size[:split, None] + size[None, split:])
            linked |= linked.T
        some = linked.any(1)
        root = _roots(linked)
        return pa.table({
            "cls": cls[some], "links": (linked @ copies)[some], "texts": linked.sum(1)[some], "root": cls[root][some],
        })

    return run


def blocks(classes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks of classes that share bands, and the pairs of blocks to compare.

    A class joins the group of the smallest leader among its shared buckets, and a group is cut
    by hash into blocks of about ``block`` n-grams. Two blocks are a pair if a bucket has
    classes of both; each block is a pair with itself. So each pair of classes with a
    common band is compared, and once, and no pair of single classes is written out.
    """
    dealt = classes.select("cls", "size", F.explode("bands").alias("h"))
    buckets = dealt.groupBy("h").agg(F.min("cls").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = cut_lineage(dealt.join(cut_lineage(buckets, "buckets"), "h"), "members")
    grouped = cut_lineage(members.groupBy("cls").agg(F.min("leader").alias("leader"), F.max("size").alias("size")), "grouped")
    parts = cut_lineage(grouped.groupBy("leader").agg(F.ceil(F.sum("size") / block).cast("int").alias("parts")), "parts")
    placed = cut_lineage(
        grouped.join(parts, "leader")
        .select("cls", F.xxhash64("leader", F.pmod(F.xxhash64("cls"), "parts")).alias("block")), "placed",
    )
    met = cut_lineage(members.select("h", "cls").join(placed, "cls").select("h", "block").distinct(), "met")
    across = met.select("h", F.col("block").alias("a")).join(met.select("h", F.col("block").alias("b")), "h").filter("a < b")
    pairs = cut_lineage(across.select("a", "b").distinct(), "pairs").withColumn("pair", F.xxhash64("a", "b"))
    sides = pairs.select("pair", F.lit(0).alias("side"), F.col("a").alias("block")).union(
        pairs.select("pair", F.lit(1), "b")
    ).union(placed.select(F.col("block").alias("pair"), F.lit(0), "block").distinct())
    return placed, sides


def join(
    docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Documents whose sets of word 5-grams have a Jaccard similarity of ``threshold`` or more are linked.

    Returns one row per input row: ``doc_id, class_id, copy_id, n_copies, n_links``. ``class_id`` is the
    smallest id that links lead to; ``copy_id`` the smallest id with an equal set, ``n_copies`` the number
    of those rows with this one, ``n_links`` the number of other rows it is linked to. Texts of fewer
    than five words have one gram of all their words. A text without words, null too, is linked to
    nothing and is its own class. A null id counts as the smallest id and is returned as null. Rows that
    repeat an id count each by their own text. Empty table: no rows. Other columns are ignored.

    Equal sets are counted first, so copies cost one row each. Only texts that share a band
    are fetched, as whole texts, and compared in blocks of bounded size by products of 0/1
    matrices; a task returns link counts and a root per text, never pairs.
    """
    rows = pick(docs, key=id_col, text=text_col).select(
        F.coalesce(F.col("key").cast("long"), F.lit(_NONE)).alias("key"), F.col("text").cast("string")
    )
    n_bands, n_rows = bands(threshold, recall)
    signed = cut_lineage(signatures(rows, n_bands, n_rows), "signatures")
    classes = cut_lineage(
        signed.filter("size > 0").groupBy("cls").agg(
            F.min("key").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("bands").alias("bands")
        ), "classes",
    )
    placed, sides = blocks(classes, block)
    asked = placed.join(sides, "block").join(classes.select("cls", "rep", "copies"), "cls").select("pair", "side", "cls", "rep", "copies")
    verified = cut_lineage(
        cut_lineage(asked, "asked").join(rows.hint("merge"), F.col("rep") == F.col("key"))  # the same plan at every size
        .select("pair", "side", "cls", "copies", "text")
        .groupBy("pair").applyInArrow(_verify(Fraction(str(threshold))), "cls long, links long, texts long, root long"), "verified",
    )
    roots = components(verified.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    sums = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    near = (
        classes.select("cls", "rep", "copies").join(sums, "cls", "left")
        .join(roots.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    near = cut_lineage(near, "near")
    least = cut_lineage(near.groupBy("root").agg(F.min("rep").alias("class")), "least")
    known = cut_lineage(near.join(least, "root").select("cls", "rep", "copies", "links", "class"), "known")
    shown = lambda c: F.nullif(F.col(c), F.lit(_NONE))
    return signed.select("key", F.when(F.col("size") > 0, F.col("cls")).alias("cls")).join(known, "cls", "left").select(
        shown("key").alias("doc_id"),
        F.when(F.col("class").isNull(), shown("key")).otherwise(shown("class")).alias("class_id"),
        F.when(F.col("rep").isNull(), shown("key")).otherwise(shown("rep")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )
