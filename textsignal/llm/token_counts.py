"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.llm.common import SPACE, chunks, joined, pick, running, spans

ZIPF = 2.7  # shift of the Zipf-Mandelbrot law that turns a piece's rank into its probability
LONG = 192  # bytes; longer pre-tokens are rare and go through the same recurrence one by one
GATHER = 48 << 20  # bytes of text whose pre-tokens share a trie
WORST = -(1 << 62)
KIND = np.full(256, 1, np.uint8)  # 0 white space, 1 other signs, 2 digits, 3 letters and all bytes beyond ASCII
KIND[SPACE] = 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 3
KIND[128:] = 3


class Pieces:
    """The pieces of a vocabulary with integer scores: micro-nats of a Zipf law over the ranks.

    Integers make sums exact, so ties don't depend on the order of additions. All single bytes
    must be pieces; then every text has a segmentation.
    """

    def __init__(self, ranks: dict[bytes, int]):
        rank = np.array(list(ranks.values()), np.float64)
        weight = np.log(1 / (rank + ZIPF)) - np.log((1 / (rank + ZIPF)).sum())
        self.score = {p: int(s) for p, s in zip(ranks, np.rint(weight * 1e6))}
        self.longest = max(map(len, ranks))
        missing = [b for b in range(256) if bytes([b]) not in self.score]
        if missing:
            raise ValueError(f"no piece for the bytes {missing[:5]}")
        data, at = joined(pa.array(list(ranks), pa.binary()))
        total = running(data)
        h = spans(total, at[:-1], at[1:])
        order = np.argsort(h)
        self.hashes, self.scores = h[order], np.rint(weight * 1e6).astype(np.int64)[order]
        self.maybe = np.zeros(1 << 22, bool)  # by the top bits: rules out most spans that are no piece
        self.maybe[h >> np.uint64(42)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Score of the piece with each hash, ``WORST`` where there is none."""
        out = np.full(len(h), WORST, np.int64)
        near = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        place = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        hit = self.hashes[place] == h[near]
        out[near[hit]] = self.scores[place[hit]]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines with a piece in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pre_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each pre-token.

    A pre-token is the longest run of bytes of one kind: letters, digits, other signs or white
    space. One blank right before a run of another kind belongs to that run.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = KIND[data]
    begin = np.zeros(len(data), bool)
    filled = at[:-1][at[:-1] < at[1:]]
    begin[filled] = True
    leads = np.zeros(len(data), bool)
    leads[:-1] = (data[:-1] == 0x20) & (kind[1:] != 0) & ~begin[1:]
    after = np.flatnonzero(leads)
    kind[after] = kind[after + 1]
    begin[1:] |= kind[1:] != kind[:-1]
    begin |= leads
    start = np.flatnonzero(begin)
    return start, np.append(start[1:], len(data)), np.searchsorted(at, start, "right") - 1


def segment(token: bytes, pieces: Pieces) -> tuple[int, int]:
    """Best score and number of pieces of one pre-token, by the plain recurrence."""
    best = [(0, 0)]
    for end in range(1, len(token) + 1):
        found = (WORST, 0)
        for begin in range(max(0, end - pieces.longest), end):
            score = pieces.score.get(token[begin:end])
            if score is not None:
                found = max(found, (best[begin][0] + score, best[begin][1] - 1))
        best.append(found)
    return best[-1][0], -best[-1][1]


def share(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best score and number of pieces of distinct pre-tokens, with one step for each node of their trie.

    The trie grows level by level. A node is a distinct prefix; its forward score is the best,
    over all pieces that end there, of the score of the node where the piece begins plus
    the piece's. Of equal scores the one with fewer pieces counts. ``data`` holds the
    pre-tokens alone. Terminal nodes store the counts.
    """
    total, length = running(data), end - start
    n = len(start)
    score, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    node = [np.zeros(n, np.int32)]  # by depth: the node of each pre-token that is so long
    best, used = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    alive = np.arange(n)
    for depth in range(1, int(length.max(initial=0)) + 1):
        alive = alive[length[alive] >= depth]
        prefix = spans(total, start[alive], start[alive] + depth)
        _, first, at = np.unique(prefix, return_index=True, return_inverse=True)
        one = alive[first]  # a pre-token through each node
        top, fewest = np.full(len(one), WORST, np.int64), np.zeros(len(one), np.int64)
        for size in range(1, min(depth, pieces.longest) + 1):
            found = pieces.find(spans(total, start[one] + depth - size, start[one] + depth))
            hit = np.flatnonzero(found > WORST)
            above = node[depth - size][one[hit]]
            value, number = best[depth - size][above] + found[hit], used[depth - size][above] + 1
            better = (value > top[hit]) | ((value == top[hit]) & (number < fewest[hit]))
            top[hit[better]], fewest[hit[better]] = value[better], number[better]
        level = np.zeros(n, np.int32)
        level[alive] = at
        node.append(level)
        best.append(top)
        used.append(fewest)
        done = length[alive] == depth
        score[alive[done]], count[alive[done]] = top[at[done]], fewest[at[done]]
    return score, count


def measure(data: np.ndarray, at: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, pre-tokens and score of each text."""
    texts = len(at) - 1
    made = []
    for low, high in chunks(at):
        part, inner = data[at[low]:at[high]], at[low:high + 1] - at[low]
        start, end, doc = pre_tokens(part, inner)
        made.append((spans(running(part), start, end), start + at[low], (end - start).astype(np.int32), (doc + low).astype(np.int32)))
    if not made:
        return (np.zeros(0, np.int64),) * 3
    h, start, length, doc = map(np.concatenate, zip(*made))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    score, count = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    begin, size = start[first], length[first].astype(np.int64)
    for i in np.flatnonzero(size > LONG):
        score[i], count[i] = segment(data[begin[i]:begin[i] + size[i]].tobytes(), pieces)
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(data[begin[short]], kind="stable")]  # a first byte's subtree stays in one part
    edges = np.concatenate([[0], np.cumsum(size[short])])
    for low, high in chunks(edges):
        own = short[low:high]
        place = np.repeat(begin[own] - edges[low:high], size[own]) + np.arange(edges[low], edges[high])
        score[own], count[own] = share(data[place], edges[low:high] - edges[low], edges[low + 1:high + 1] - edges[low], pieces)
    sums = [np.zeros(texts, np.int64) for _ in range(3)]
    for out, value in zip(sums, (count[number], np.ones(len(doc), np.int64), score[number])):
        np.add.at(out, doc, value)
    return tuple(sums)


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under the unigram model: ``doc_id, n_tokens, n_pretokens, score``.

    ``vocabulary`` is a file on every machine, of pieces in base 64 and their ranks. ``score`` is the
    log probability of the best segmentation. One narrow pass; each task keeps a trie over the
    distinct pre-tokens of ``GATHER`` bytes of text. Null and empty text: 0 tokens, score 0. Repeated
    rows and null ids are kept as they are. Empty table: no rows. Other columns are ignored.
    """

    def run(batches):
        pieces = Pieces(read_ranks(vocabulary))
        for b in batches:
            data, at = joined(b.column("text"))
            for low, high in chunks(at, GATHER):
                tokens, runs, score = measure(data[at[low]:at[high]], at[low:high + 1] - at[low], pieces)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(low, high - low), pa.array(tokens), pa.array(runs), pa.array(score / 1e6)],
                    ["doc_id", "n_tokens", "n_pretokens", "score"],
                )

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, score double")
