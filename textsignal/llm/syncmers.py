"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.llm.common import mix, pick

K, INNER = 16, 8  # code points of a k-mer, and of its inner substrings
SLOTS = 64  # of a fingerprint
EMPTY = 0xFFFF
ROWS = 2048  # documents in a block
_BASE = 0x9E3779B97F4A7C15
_NONE = -(1 << 63)


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each closed syncmer of the text.

    A k-mer is chosen when the smallest hash among its inner substrings is at its first or last
    one. That depends on the k-mer alone, so equal passages have equal anchors whatever stands
    around them. A text shorter than ``K`` is its own anchor; an empty one has none.
    """
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(h) < K:
        weight = np.array([pow(_BASE, i, 1 << 64) for i in range(len(h))], np.uint64)
        return np.zeros(min(1, len(h)), np.int64), mix((h * weight).sum(keepdims=True) ^ np.uint64(len(h)))[:min(1, len(h))]
    width = 1
    while width < K:
        h = h[:-width] + h[width:] * np.uint64(pow(_BASE, width, 1 << 64))
        width *= 2
        if width == INNER:
            inner = mix(h)
    least, seen, span = inner, 1, K - INNER + 1
    while 2 * seen <= span:
        least = np.minimum(least[:-seen], least[seen:])
        seen *= 2
    least = np.minimum(least[:len(inner) - span + 1], least[span - seen:])
    chosen = np.flatnonzero((inner[:len(least)] == least) | (inner[span - 1:] == least))
    return chosen, mix(h[chosen])


def sketch(anchors: np.ndarray) -> np.ndarray:
    """One 16-bit value a slot: from the smallest anchor among those whose top bits name the slot."""
    out = np.full(SLOTS, EMPTY, np.uint16)
    anchors = np.sort(anchors)
    slot = (anchors >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else slot
    out[slot[first]] = np.minimum(anchors[first] & np.uint64(EMPTY), EMPTY - 1)
    return out


def fingerprint(text: str) -> np.ndarray:
    return sketch(syncmers(text)[1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the anchor sets: equal slots among those used by either. Two empty sketches are alike."""
    used = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _printed(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_anchors``. A fingerprint has ``SLOTS`` groups of four hexadecimal digits;
    ``ffff`` is a slot without anchor. The next document is the next in ascending id, and the
    first after the last. Null text: empty. Null id: before all others. Repeated ids: in the order
    of their texts. One row: it is its own next. Empty table: no rows. Other columns are ignored.

    Ids are cut into blocks of equal size by a range shuffle of ids alone; the driver gets one
    id a block. A block also receives the first document of the next one, so the texts are
    shuffled once and every block is worked on as a stream.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = rows.select(F.coalesce("doc_id", F.lit(_NONE)).alias("key"))
    n = max(1, -(-keys.count() // ROWS))

    def least(batches):
        found = [pc.min(b.column("key")).as_py() for b in batches if b.num_rows]
        if found:
            yield pa.RecordBatch.from_pydict({"key": [min(found)]})

    bounds = np.array(sorted(r[0] for r in keys.repartitionByRange(n, "key").mapInArrow(least, "key long").collect()), np.int64)
    last = max(0, len(bounds) - 1)

    def deal(batches):
        for b in batches:
            key = np.asarray(pc.fill_null(b.column("doc_id"), _NONE), np.int64)
            block = np.maximum(np.searchsorted(bounds, key, "right") - 1, 0)
            leading = np.flatnonzero(key == bounds[block]) if len(bounds) else block[:0]
            before = np.where(block[leading] == 0, last, block[leading] - 1)
            rows = np.concatenate([np.arange(len(key)), leading])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([block, before])), pa.array(np.arange(len(rows)) >= len(key)),
                 pa.array(key[rows]), pc.fill_null(b.column("text"), "").take(pa.array(rows))],
                ["block", "halo", "key", "text"],
            )

    def pair(batches):
        held = None  # block, key, text, fingerprint and number of anchors of the row before

        def made(held, text, sign):
            _, key, own, f, n = held
            other = edited(own, text)
            g = fingerprint(other)
            return (
                None if key == _NONE else key, len(own), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
                _printed(f), _printed(g), likeness(f, g), likeness(f, sign), n,
            )

        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        for b in batches:
            out = []
            for block, halo, key, text in zip(*(b.column(c).to_pylist() for c in ("block", "halo", "key", "text"))):
                if halo and (held is None or held[0] != block):
                    continue  # only the first of several leading rows follows the block's last
                anchors = syncmers(text)[1]
                sign = sketch(anchors)
                if held is not None and held[0] == block:
                    out.append(made(held, text, sign))
                held = None if halo else (block, key, text, sign, len(anchors))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], list(names)
            )

    return (
        rows.mapInArrow(deal, "block long, halo boolean, key long, text string")
        .repartition("block").sortWithinPartitions("block", "halo", "key", "text")
        .mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                          "near_edited double, near_next double, n_anchors long")
    )
