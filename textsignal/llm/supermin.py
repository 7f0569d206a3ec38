"""SuperMinHash near-duplicates: correlated ranks make the signature, bands find candidates, full sets confirm, union-find groups."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.llm.common import chunks, joined, mix, pick
from textsignal.llm.components import components
from textsignal.llm.ngram_join import bands, grams, overlaps, set_hashes
from textsignal.sources.tables import cut_lineage

N = 2  # words of a shingle
THRESHOLD = 0.8
RECALL = 0.99999  # of a pair at the threshold, if registers were independent; correlated ones vary less
REGISTERS = 96  # at most, in all bands
BLOCK = 1 << 16  # shingles of the texts that are compared as one block
DRAWN = 1 << 15  # elements whose ranks are drawn together
TEXT = 64  # shingles that a text counts for in a block besides its own: a block has a bounded number of texts
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)
_OPEN = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(element: np.ndarray, at: np.ndarray, size: int, limit: int = DRAWN) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` registers for each non-empty set of element hashes.

    Elements are taken ``limit`` at a time, also those of one large set: registers keep the least offer of all.
    """
    filled = np.flatnonzero(at[1:] > at[:-1])
    owner = np.repeat(np.arange(len(filled)), np.diff(at)[filled])
    out = np.full((len(filled), size), _OPEN)
    for low in range(0, len(element), limit):
        own = owner[low:low + limit]
        rows = slice(own[0], own[-1] + 1)
        out[rows] = np.minimum(out[rows], offers(element[low:low + limit], own - own[0], size))
    return out


def offers(element: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """The least offer to each register of each owner; owners are numbered from 0, in order.

    Each element draws its own random permutation of the registers, step by step. In step j it offers
    j plus a random fraction to the register that its permutation has at place j; a register keeps its least
    offer. So an element's ranks are all different, which makes estimates vary less than independent
    ones. Offers of later steps are larger than all before: a set stops as soon as each register has
    one, after about ``size * log(size) / n`` steps for n elements, and not after ``size``.
    """
    out = np.full((int(owner[-1]) + 1) * size, _OPEN)
    places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(element), 1))
    for step in range(size):
        draw = mix(element + np.uint64((step + 1) * int(_STEP) % (1 << 64)))
        other = step + ((draw >> np.uint64(32)) * np.uint64(size - step) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(element))
        place = places[row, other]
        places[row, other] = places[:, step]
        register = owner * size + place
        open_ = np.flatnonzero(out[register] >= np.uint64(step) << np.uint64(32))
        offer = np.uint64(step) << np.uint64(32) | draw[open_] & np.uint64(0xFFFFFFFF)
        np.minimum.at(out, register[open_], offer)
        live = (out.reshape(-1, size) == _OPEN).any(1)[owner]
        if not live.any():
            break
        if live.mean() < 0.75:
            element, owner, places = element[live], owner[live], places[live]
    return out.reshape(-1, size)


def banded(signature: np.ndarray, n_bands: int) -> np.ndarray:
    """A hash of each band of the registers; it names its band, too."""
    rows = signature.shape[1] // n_bands
    out = np.zeros((len(signature), n_bands), np.uint64)
    for i in range(n_bands * rows):
        out[:, i // rows] = mix(out[:, i // rows] * _STEP + signature[:, i] + np.uint64(i + 1))
    return out.view(np.int64)


def signatures(docs: DataFrame, n_bands: int, rows: int, n: int = N) -> DataFrame:
    """``key, cls, size, bands``: hash of a text's set of shingles, its size and its bands."""

    def run(batches):
        for b in batches:
            data, at = joined(b.column("text"))
            for low, high in chunks(at):
                gram, edge = grams(data[at[low]:at[high]], at[low:high + 1] - at[low], n)
                size = np.diff(edge)
                values = banded(registers(gram, edge, n_bands * rows), n_bands)
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum((size > 0) * n_bands)]).astype(np.int32), pa.array(values.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").slice(low, high - low), pa.array(set_hashes(gram, edge)), pa.array(size), lists],
                    ["key", "cls", "size", "bands"],
                )

    return docs.mapInArrow(run, "key long, cls long, size long, bands array<long>")


class Forest:
    """Union-find over places; a root is the smallest place of its tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, others: np.ndarray) -> None:
        """Put the others into the tree of x; those that have a parent in common go together."""
        for y in np.unique(self.up[others]):
            x, y = self.root(x), self.root(y)
            x, y = min(x, y), max(x, y)
            self.up[y] = x


def _confirm(threshold: Fraction, n: int):
    up, down = threshold.numerator, threshold.denominator

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("cls", "ascending")])
        side, cls = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("side", "cls"))
        gram, at = grams(*joined(rows.column("text")), n)
        own = set_hashes(gram, at) == cls  # a repeated id may bring other texts along
        own[1:] &= (cls[1:] != cls[:-1]) | (side[1:] != side[:-1])
        if not own.all():
            gram, at = gram[np.repeat(own, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at)[own])])
            side, cls = side[own], cls[own]
        size, split = np.diff(at), int((side == 0).sum())
        found = overlaps(gram, at, split if split < len(size) else None)
        right = size if split == len(size) else size[split:]
        near = found * (up + down) >= up * (size[:split, None] + right[None, :])
        forest, base = Forest(len(size)), len(size) - len(right)
        for x in np.flatnonzero(near.any(1)):
            forest.join(x, base + np.flatnonzero(near[x]))
        root = np.array([forest.root(x) for x in range(len(size))], np.int64)
        kept = root != np.arange(len(size))
        return pa.table({"u": pa.array(cls[kept], pa.int64()), "v": pa.array(cls[root[kept]], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, *, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Groups of texts whose sets of ``n``-word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``. ``component_id`` is the smallest id that
    links lead to, ``kept`` whether it is the row's own. Words are split at ASCII white space, A-Z in lower case. A
    text of fewer than n words has one shingle of all of them; a text without words, null too, has none, is linked
    to nothing and is its own component. A null id counts as the smallest and is returned as null. Rows that repeat
    an id count each by their own text. Empty table: no rows. Other columns are ignored.

    Equal sets are one class. Classes that share a band join the group of the smallest leader they meet; a group
    is cut by hash into blocks of about ``block`` shingles. First each block is compared with itself and with its
    group's leader. Classes of buckets that are still in several components are then dealt anew, by their largest
    such bucket and another hash, and each block is compared with itself: so what is alike but was dealt apart
    comes together. Of a bucket that is in several components even then, classes outside its largest component ask
    all blocks that have classes in the bucket; of two classes that are both outside, one asks. Those that ask a
    block meet it together, so its texts are fetched once for as many askers as a block holds. Pairs that one component holds already are not compared: a group of
    many near copies costs its size, not its square, and no link that could join two components is left out.
    """
    rows = pick(docs, key=id_col, text=text_col).select(
        F.coalesce(F.col("key").cast("long"), F.lit(_NONE)).alias("key"), F.col("text").cast("string")
    )
    n_bands, n_rows = bands(threshold, recall, REGISTERS)
    signed = cut_lineage(signatures(rows, n_bands, n_rows, n), "signed")
    classes = cut_lineage(
        signed.filter("size > 0").groupBy("cls").agg(F.min("key").alias("rep"), F.max("size").alias("size"), F.first("bands").alias("bands")),
        "classes",
    )
    dealt = classes.select("cls", "size", F.explode("bands").alias("h"))
    buckets = dealt.groupBy("h").agg(F.min("cls").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = cut_lineage(dealt.join(cut_lineage(buckets, "buckets"), "h"), "members")
    grouped = cut_lineage(members.groupBy("cls").agg(F.min("leader").alias("leader"), F.max("size").alias("size")), "grouped")

    def cut(classes: DataFrame, name: str, seed: int = 0) -> DataFrame:
        """``cls, leader, block``: classes of a group in blocks by hash."""
        parts = cut_lineage(classes.groupBy("leader").agg(F.ceil(F.sum(F.col("size") + TEXT) / block).cast("int").alias("parts")), f"{name}-parts")
        number = F.pmod(F.xxhash64("cls", F.lit(seed)), "parts")
        return cut_lineage(classes.join(parts, "leader").select("cls", "leader", F.xxhash64("leader", number).alias("block")), name)

    def opened(links: DataFrame, name: str) -> DataFrame:
        """``h, cls, root, main, m``: the buckets of m classes that are in several components, and the largest of these."""
        now = cut_lineage(components(links), f"{name}-components").select(F.col("u").alias("cls"), F.col("v").alias("root"))
        held = cut_lineage(members.select("h", "cls").join(now, "cls", "left").withColumn("root", F.coalesce("root", "cls")), f"{name}-held")
        sizes = held.groupBy("h", "root").agg(F.count("*").alias("m"))
        main = sizes.groupBy("h").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("m"), F.count("*").alias("n"))
        return cut_lineage(held.join(cut_lineage(main.filter("n > 1").drop("n"), f"{name}-main"), "h"), name)

    confirm = _confirm(Fraction(str(threshold)), n)

    def confirmed(asked: DataFrame, name: str) -> DataFrame:
        """Links ``u, v`` from the comparisons ``pair, side, cls``: each pair's first side with itself, or with its second."""
        found = cut_lineage(asked.join(classes.select("cls", "rep"), "cls"), f"{name}-asked")
        texts = found.join(rows.hint("merge"), F.col("rep") == F.col("key")).select("pair", "side", "cls", "text")
        return cut_lineage(texts.groupBy("pair").applyInArrow(confirm, "u long, v long"), name)

    placed = cut(grouped, "placed")
    led = placed.select(F.col("block").alias("pair"), F.col("leader").alias("cls")).distinct()
    asked = placed.select(F.col("block").alias("pair"), "cls").union(led).distinct().withColumn("side", F.lit(0))
    links = confirmed(asked, "inside")

    left = opened(links, "left")
    widest = left.groupBy("cls").agg(F.max_by("h", F.struct("m", "h")).alias("leader"))
    dealt_anew = cut(widest.join(grouped.select("cls", "size"), "cls"), "dealt-anew", 1)
    several = dealt_anew.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").select("block")
    asked = dealt_anew.join(several, "block").select(F.col("block").alias("pair"), "cls", F.lit(0).alias("side"))
    links = links.union(confirmed(asked, "anew"))

    still = opened(links, "still")
    placed = cut_lineage(still.join(dealt_anew.select("cls", F.col("block").alias("a")), "cls").select("h", "cls", "root", "main", "a"), "still-placed")
    met = placed.groupBy("h", "a").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.expr("bool_or(root = main)").alias("holds_main"))
    apart = placed.filter("root <> main").select("h", "cls", "root", F.col("a").alias("own"))
    asking = apart.join(met, "h").filter("(own < a OR own > a AND holds_main) AND (low <> root OR high <> root)").select("a", "cls").distinct()
    asking = cut_lineage(asking.join(grouped.select("cls", "size"), "cls"), "asking")
    parts = cut_lineage(asking.groupBy("a").agg(F.ceil(F.sum(F.col("size") + TEXT) / block).cast("int").alias("parts")), "asking-parts")
    asking = cut_lineage(asking.join(parts, "a").select("a", "cls", F.xxhash64("a", F.pmod(F.xxhash64("cls"), "parts")).alias("pair")), "asking-placed")
    asked = placed.select("a", "cls").distinct().join(asking.select("a", "pair").distinct(), "a").select("pair", F.lit(0).alias("side"), "cls").union(
        asking.select("pair", F.lit(1), "cls")
    )
    links = links.union(confirmed(asked, "across"))

    roots = components(links).select(F.col("u").alias("cls"), F.col("v").alias("root"))
    near = cut_lineage(classes.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "near")
    least = cut_lineage(near.groupBy("root").agg(F.min("rep").alias("least")), "least")
    known = cut_lineage(near.join(least, "root").select("cls", "least"), "known")
    own = F.nullif(F.col("key"), F.lit(_NONE))
    found = signed.select("key", "size", F.when(F.col("size") > 0, F.col("cls")).alias("cls")).join(known, "cls", "left")
    component = F.when(F.col("least").isNull(), own).otherwise(F.nullif(F.col("least"), F.lit(_NONE)))
    return found.select(
        own.alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), own.eqNullSafe(component).alias("kept")
    )


ORACLE_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(t) >= 2 THEN list_distinct([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) WHEN len(t) = 1 THEN t ELSE [] END AS g
  FROM w
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS m, b.n AS n, count(*) AS common
  FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT u, v FROM shared WHERE 100 * common >= 80 * (m + n - common)
), edges AS (
  SELECT u, v FROM links UNION SELECT v, u FROM links
), reach AS (
  SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
), root AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(root.v, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(root.v, s.doc_id) AS kept
FROM s LEFT JOIN root ON s.doc_id = root.u"""
