"""Language-model scores from an n-gram model counted over the corpus and read through Elias-Fano tries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.llm.batches import bundle, packed, unbundled, unpacked
from textsignal.llm.common import LOWER, chunks, hashed_words, joined, mix, pick, remainder
from textsignal.llm.elias_fano import Trie, quantise, restore
from textsignal.sources.tables import cut_lineage

BATCH = 5 << 20  # bytes of text that are counted and scored together
SHARD = 8 << 20  # bytes of text for each shard of the counts
PRIOR = ((3.0, 0.9), (1.0, 1.0))  # factor and power of a context's count: how many counts the shorter context weighs
LEAST = 1  # occurrences in training texts that a trigram of the model has: none is left out
END = np.uint64(0xE7D0E7D0E7D0E7D1)  # the token at the end of each text
LONGER = np.uint64(0xFFFFFFFFFFFFFF00)  # bits of the hash that name a bigram or trigram; words have all 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of a batch of texts."""

    def __init__(self, table: pa.Table):
        data, at = joined(table.column("text"))
        parts = []
        for low, high in chunks(at):
            h, edge = hashed_words(LOWER[data[at[low]:at[high]]], at[low:high + 1] - at[low])
            parts.append((np.insert(h, edge[1:], END), np.diff(edge) + 1))
        self.hash = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
        self.size = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.learn = np.repeat(~np.asarray(table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool), self.size)

    def starts(self, n: int) -> np.ndarray:
        """Where n-grams begin: not among the last n - 1 tokens of a text."""
        inside = np.ones(len(self.hash), bool)
        for back in range(1, n):
            inside[(self.edge[1:] - back)[self.size >= back]] = False
        return np.flatnonzero(inside).astype(np.int32)

    def distinct(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the n-grams at the given places, a place of each, and the number of each place's n-gram."""
        h = self.hash[at]
        if n > 1:
            for i in range(1, n):
                h = h * _STEP + self.hash[at + i]
            h = mix(h + np.uint64(n)) & LONGER
        keys, first, number = np.unique(h, return_index=True, return_inverse=True)
        return keys, at[first], number.astype(np.int32)

    def learned(self, at: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """Occurrences of each n-gram in training texts."""
        return np.bincount(number[self.learn[at]], minlength=n).astype(np.uint32)


def _asked(batch: int, level: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> dict[str, list]:
    """Rows that bring sorted n-grams and their counts to the shards of their hashes."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    rows = {"batch": [], "level": [], "shard": [], "keys": [], "counts": []}
    for i in range(shards):
        low, high = edges[i], edges[i + 1]
        if low < high:
            rows["batch"].append(batch)
            rows["level"].append(level)
            rows["shard"].append(i)
            rows["keys"].append(packed(np.diff(keys[low:high], prepend=np.uint64(0))))
            rows["counts"].append(packed(counts[low:high]))
    return rows


ASKED = "batch long, level int, shard int, keys binary, counts binary"
ANSWERED = "batch long, level int, shard int, totals binary, n_distinct long, n_tokens long"


def _answer(rows: pa.Table) -> pa.Table:
    """Corpus counts of a shard's n-grams, for each batch in the order it asked; sizes of the shard on one row."""
    batches, blobs, counted = (rows.column(c).to_pylist() for c in ("batch", "keys", "counts"))
    keys = [np.cumsum(unpacked(k, np.uint64)) for k in blobs]
    counts = np.concatenate([unpacked(c, np.uint32) for c in counted]).astype(np.int64)
    found, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, number, counts)
    answers, at = [], 0
    for k in keys:
        answers.append(packed(total[number[at:at + len(k)]]))
        at += len(k)
    n, level = len(batches), rows.column("level")[0].as_py()
    one = [0] * (n - 1)
    return pa.table({
        "batch": pa.array(batches, pa.int64()), "level": pa.array([level] * n, pa.int32()),
        "shard": pa.array(rows.column("shard").to_pylist(), pa.int32()), "totals": pa.array(answers, pa.binary()),
        "n_distinct": pa.array([int((total > 0).sum()), *one], pa.int64()), "n_tokens": pa.array([int(total.sum()), *one], pa.int64()),
    })


def _totals(answers: pa.Table, level: int) -> np.ndarray:
    own = answers.select(["level", "shard", "totals"]).filter(pc.equal(answers.column("level"), level))
    rows = sorted((r["shard"], r["totals"]) for r in own.to_pylist())
    return np.concatenate([unpacked(t, np.int64) for _, t in rows] or [np.zeros(0, np.int64)])


def _prior(counts: np.ndarray, order: int) -> np.ndarray:
    """Weight of the shorter context's distribution; it grows as the number of different successors does."""
    factor, power = PRIOR[order - 2]
    return factor * counts.astype(np.float64) ** power


def _log(values: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(values, 1e-300))


def score(grams: Grams, answers: pa.Table, n_tokens: int, n_distinct: int) -> dict[str, np.ndarray]:
    """Known tokens, base score and model score of each text of a batch.

    The trie holds the model's n-grams that occur in the batch, with probabilities smoothed by
    a Dirichlet prior: p(w | h) = (c(hw) + k p(w | shorter h)) / (c(h) + k), where k grows with c(h).
    All else backs off. What the trie is built from goes as soon as it is used: a worker holds little beside the trie.
    """
    everywhere, two = grams.starts(1), grams.starts(2)
    word, _, at_word = grams.distinct(everywhere, 1)
    c1 = _totals(answers, 1)
    base = _log((c1 + 1) / (n_tokens + n_distinct + 1))
    three = grams.starts(3)
    triple_at, at_triple = grams.distinct(three, 3)[1:]
    pair_at, at_pair = grams.distinct(two, 2)[1:]
    c2, c3 = _totals(answers, 2), _totals(answers, 3)

    # the model's part: words, pairs and triples that the training texts have, numbered in order
    own = np.flatnonzero(c1 > 0)
    number = np.full(len(word), -1, np.int32)
    number[own] = np.arange(len(own))
    left, right = number[at_word[pair_at]], number[at_word[pair_at + 1]]
    kept = np.flatnonzero(c2 > 0)
    kept = kept[np.lexsort((right[kept], left[kept]))]
    pair_no = np.full(len(pair_at), -1, np.int32)
    pair_no[kept] = np.arange(len(kept))
    p1 = 10 ** base[own]
    k2, k3 = _prior(c1[own], 2), _prior(c2[kept], 3)
    p2 = (c2[kept] + k2[left[kept]] * p1[right[kept]]) / (c1[own] + k2)[left[kept]]
    of_place = np.full(len(grams.hash), -1, np.int32)
    of_place[two] = at_pair
    good = np.flatnonzero(c3 >= LEAST)
    above, below = pair_no[of_place[triple_at[good]]], pair_no[of_place[triple_at[good] + 1]]
    c3, pairs, whole = c3[good], (left[kept], right[kept]), c2[kept] + k3
    del number, left, right, kept, pair_no, good, c2
    order = np.lexsort((pairs[1][below], above))
    above, below, c3 = above[order], below[order], c3[order]
    del order
    prob = [quantise(_log(p1)), quantise(_log(p2)), quantise(_log((c3 + k3[above] * p2[below]) / whole[above]))]
    back = [quantise(_log(k2 / (c1[own] + k2))), quantise(_log(k3 / whole))]
    del c3, whole, p1, p2, k2, k3
    trie = Trie(word[own], pairs, (above, below), prob, back)
    del pairs, above, below
    # queries: every distinct n-gram of the batch once, through the trie alone
    w = trie.word(word)
    unknown = math.log10(1 / (n_tokens + n_distinct + 1))
    s1 = np.where(w >= 0, restore(trie.prob[0][np.maximum(w, 0)]), unknown) if len(own) else np.full(len(word), unknown)
    a, b = w[at_word[pair_at]], w[at_word[pair_at + 1]]
    p = trie.pair(a, b)
    s2 = s1[at_word[pair_at + 1]].copy()
    if len(own):
        s2 += np.where(a >= 0, restore(trie.back[0][np.maximum(a, 0)]), 0.0)
    s2[p >= 0] = restore(trie.prob[1][p[p >= 0]])
    value = s1[at_word]
    value[two + 1] = s2[at_pair]
    del a, b, s1, s2, two, pair_at, at_pair
    context = p[of_place[three]]
    value[three[context >= 0] + 2] += restore(trie.back[1][context[context >= 0]])
    del context
    t = trie.triple(p[of_place[triple_at]], w[at_word[triple_at + 1]], p[of_place[triple_at + 1]])
    hit = t[at_triple] >= 0
    value[three[hit] + 2] = restore(trie.prob[2][t[at_triple][hit]])

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, grams.edge[:-1]) if len(grams.size) else np.zeros(0)

    return {
        "n_known": per_text((c1 > 0)[at_word].astype(np.int64)), "base_score": per_text(base[at_word]), "score": per_text(value),
    }


def score_texts(
    docs: DataFrame, *, folds: int = 7, held: int = 2, batch: int = BATCH, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """log10 probability of every whole text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are runs of bytes other than ASCII white space, A-Z in lower case, and one end. The model is a
    trigram model over the texts whose crc32 of the id modulo ``folds`` isn't ``held``; ``base_score`` is
    the add-one unigram score. Counts cover the whole corpus: each batch of texts sends its distinct
    n-grams to the shards of their hashes and gets corpus counts back, so a frequent n-gram is one
    entry a batch and nothing is held whole anywhere. Trigrams of one training occurrence are part of the
    model as all others are. Each batch then builds a trie of its part of the model and is scored through it.
    Null text: empty, its end alone is scored. Null id: its crc32 is that of the empty text. Repeated
    rows are counted and scored each. Empty table: no rows. Other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(
        F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), folds) == held).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(n_bytes / SHARD))
    bundles = cut_lineage(bundle(rows, batch), "bundles")

    def ask(batches):
        for b in batches:
            for key, blob in zip(b.column("batch").to_pylist(), b.column("docs").to_pylist()):
                grams = Grams(unbundled(blob))
                for n in (1, 2, 3):
                    at = grams.starts(n)
                    keys, _, number = grams.distinct(at, n)
                    yield pa.RecordBatch.from_pydict(
                        _asked(key, n, keys, grams.learned(at, number, len(keys)), shards), pa.schema(ASKED_ARROW)
                    )

    asked = bundles.mapInArrow(ask, ASKED)
    answers = cut_lineage(asked.groupBy("level", "shard").applyInArrow(_answer, ANSWERED), "counts")
    n_distinct, n_tokens = answers.filter("level = 1").agg(F.sum("n_distinct"), F.sum("n_tokens")).first()
    n_distinct, n_tokens = n_distinct or 0, n_tokens or 0
    counts = answers.select("batch", "level", "shard", "totals")

    def finish(bundles: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for blob in bundles.column("docs").to_pylist():
            table = unbundled(blob)
            grams = Grams(table)
            made = score(grams, answers, n_tokens, n_distinct)
            out.append(pa.table({
                "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(grams.size, pa.int64()),
                "n_known": pa.array(made["n_known"], pa.int64()), "train_tokens": pa.array(np.full(len(table), n_tokens, np.int64)),
                "base_score": pa.array(made["base_score"], pa.float64()), "score": pa.array(made["score"], pa.float64()),
            }))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], k) for c, k in SCORED_ARROW})

    return bundles.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


ASKED_ARROW = [("batch", pa.int64()), ("level", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
SCORED_ARROW = [
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
]
