"""Cross-tokenizer alignment: byte intervals of two tokenizers' tokens, coalesced into groups and expanded into links."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.llm import bytebpe
from textsignal.llm.batches import packed, unbundled, unpacked
from textsignal.llm.common import chunks, joined, mix, pick
from textsignal.sources.tables import cut_lineage

BATCH = 4 << 20  # bytes of text whose pairs are counted together
SHARD = 8 << 20  # bytes of text for each shard of the counts
PART = 1 << 18  # bytes of text whose tokens are aligned at once
LONG = 1 << 20  # characters from which a text is given to the second tokenizer in parts
BLANK = "▁"  # how the second vocabulary writes a blank
_state: dict[str, object] = {}


class Vocabulary:
    """The bytes of each id: one array, and where each id's bytes start and end."""

    def __init__(self, entries: list[bytes]):
        self.edge = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.edge[ids + 1] - self.edge[ids]

    def join(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids in a row."""
        size = self.sizes(ids)
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.edge[ids] - (end - size), size) + np.arange(int(size.sum()))]


class First:
    """Byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.path = path
        merges = bytebpe.merger(path)
        entries = dict.fromkeys(range(merges.max_token_value + 1), b"")
        entries |= {merges.encode_single_token(b): b for b in merges.token_byte_values()}
        self.vocabulary = Vocabulary(list(entries.values()))
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = [any(a in t for a in self.added) for t in texts]
        plain = iter(bytebpe.encode([t for t, s in zip(texts, special) if not s], self.path))
        return [
            np.array(self.own.encode(t, add_special_tokens=False).ids, np.uint32) if s else next(plain)
            for t, s in zip(texts, special)
        ]


class Second:
    """Pieces with byte fallback. The model itself puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)
        ])
        # no piece has a blank behind another character: a text can be cut before a blank
        self.apart = not any(BLANK in n.lstrip(BLANK) for n in names)

    def parts(self, text: str) -> list[str]:
        """The text cut at the first blank of a run into parts of some ``LONG`` characters; the model gives each its blank again."""
        out, low = [], 0
        while self.apart and len(text) - low > LONG:
            at = text.find(" ", low + LONG)
            while 0 < at and text[at - 1] == " ":
                at = text.find(" ", at + 1)
            if at < 0 or at + 1 == len(text):
                break
            out.append(text[low:at])
            low = at + 1
        return [*out, text[low:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [
            np.concatenate([np.array(ids, np.uint32) for ids in self.model.encode(self.parts(t), num_threads=1)]) for t in texts
        ]


def tokenizers(first: str, second: str) -> tuple[First, Second]:
    for kind, path in ((First, first), (Second, second)):
        if path not in _state:
            _state[path] = kind(path)
    return _state[first], _state[second]


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group of each interval: one breaks off where a start, in order, reaches the largest end so far."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.zeros(len(order), np.int64)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(new)
    return group


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of intervals of A and B that share a byte. Each side is in order and without gaps."""
    first = np.searchsorted(b_end, a_start, "right")
    size = np.searchsorted(b_start, a_end, "left") - first
    place = np.cumsum(size) - size
    return np.repeat(np.arange(len(a_start)), size), np.repeat(first - place, size) + np.arange(int(size.sum()))


def written(ids: np.ndarray, kind: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2;`` of tokens in order of group, kind and place, as bytes; and where each token's text ends."""
    most = len(str(int(ids.max(initial=0))))
    digits = np.full((len(ids), most + 1), ord(","), np.uint8)
    left, wide = ids.astype(np.int64), np.ones(len(ids), np.int64)
    for i in range(most - 1, -1, -1):
        wide[left > 0] = most - i
        digits[:, i] = 48 + left % 10
        left //= 10
    turn = np.ones(len(ids), bool)
    turn[:-1] = (kind[1:] != kind[:-1]) | (group[1:] != group[:-1])
    digits[turn, most] = np.where(kind[turn] == 0, ord("|"), ord(";"))
    shown = np.arange(most + 1)[None, :] >= (most - wide)[:, None]
    return digits[shown], np.cumsum(wide + 1)


def align(texts: pa.Array, first: First, second: Second) -> dict[str, np.ndarray | list[str]]:
    """Numbers of each text, its groups' hash, and its distinct pairs: ``doc, code, n`` (code: A id times 2**32, plus B id)."""
    strings = [t or "" for t in texts.to_pylist()]
    whole = [(" " + t).encode() for t in strings]
    n = len(strings)
    a_ids = first.encode([" " + t if t else "" for t in strings])
    b_ids = second.encode(strings)
    good = np.array([
        bool(t) and first.vocabulary.join(a).tobytes() == w and second.vocabulary.join(b).tobytes() == w
        for t, w, a, b in zip(strings, whole, a_ids, b_ids)
    ], bool)
    none = np.zeros(0, np.uint32)
    a_ids, b_ids = ([x if g else none for x, g in zip(ids, good)] for ids in (a_ids, b_ids))
    at = np.concatenate([[0], np.cumsum([len(w) if g else 0 for w, g in zip(whole, good)])]).astype(np.int64)
    out = {"n_a": np.array([len(x) for x in a_ids], np.int64), "n_b": np.array([len(x) for x in b_ids], np.int64)}

    def intervals(ids, vocabulary):
        flat = np.concatenate([*ids, none]).astype(np.int64)
        end = np.cumsum(vocabulary.sizes(flat))
        return flat, end - vocabulary.sizes(flat), end

    (a, a_start, a_end), (b, b_start, b_end) = intervals(a_ids, first.vocabulary), intervals(b_ids, second.vocabulary)
    group = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]))
    kind = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((kind, group))
    text, ends = written(np.concatenate([a, b])[order], kind[order], group[order])
    last = np.cumsum(out["n_a"] + out["n_b"])
    stop = np.concatenate([[0], ends])[last]
    begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    out["groups_sha256"] = [
        hashlib.sha256(text[i:j - 1].tobytes()).hexdigest() if j > i else "" for i, j in zip(begin.tolist(), stop.tolist())
    ]
    opened = np.zeros(0, np.int64)
    if len(a):
        opened = a_start[np.concatenate([[True], group[:len(a)][1:] != group[:len(a)][:-1]])]
    out["n_groups"] = np.bincount(np.searchsorted(at, opened, "right") - 1, minlength=n)[:n] if n else np.zeros(0, np.int64)
    i, j = overlaps(a_start, a_end, b_start, b_end)
    doc = np.repeat(np.arange(n), out["n_a"])[i]
    out["n_links"] = np.bincount(doc, minlength=n) if n else np.zeros(0, np.int64)
    code = a[i] << 32 | b[j]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return out | {"doc": doc[at], "code": code[at], "n": np.diff(np.append(at, len(code)))}


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
LINKED = "batch long, docs binary, codes binary, counts binary, place binary, n binary, sizes binary"
LINKED_ARROW = [("batch", pa.int64()), *((c, pa.binary()) for c in ("docs", "codes", "counts", "place", "n", "sizes"))]


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def linked(docs: DataFrame, first: str, second: str, limit: int = BATCH) -> DataFrame:
    """Texts in batches, aligned: the numbers of each, the batch's distinct pairs with the number of texts that have each, and each text's pairs."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        tables, held, size = [], [], 0

        def flush():
            docs = pa.concat_tables(tables)
            code = np.concatenate([h[0] for h in held])
            keys, place, counts = np.unique(code, return_inverse=True, return_counts=True)
            sizes = np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_pydict({
                "batch": [part << 32 | number], "docs": [_stored(docs)], "codes": [packed(np.diff(keys, prepend=0))],
                "counts": [packed(counts.astype(np.uint32))], "place": [packed(np.diff(place.astype(np.int64), prepend=0).astype(np.int32))],
                "n": [packed(np.concatenate([h[1] for h in held]).astype(np.uint32))], "sizes": [packed(sizes.astype(np.uint32))],
            }, pa.schema(LINKED_ARROW))

        for b in batches:
            _, at = joined(b.column("text"))
            for low, high in chunks(at, PART):
                made = align(b.column("text").slice(low, high - low), *tokenizers(first, second))
                tables.append(pa.table({
                    "doc_id": b.column("doc_id").slice(low, high - low), **{c: pa.array(made[c], pa.int64()) for c in NUMBERS},
                    "groups_sha256": pa.array(made["groups_sha256"], pa.string()),
                }))
                held.append((made["code"], made["n"], np.bincount(made["doc"], minlength=high - low)))
                size += int(at[high] - at[low])
                if size >= limit:
                    yield flush()
                    tables, held, size, number = [], [], 0, number + 1
        if tables:
            yield flush()

    return docs.mapInArrow(run, LINKED)


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(codes.astype(np.uint64)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _ask(shards: int):
    def run(batches):
        for b in batches:
            for batch, codes, counts in zip(*(b.column(c).to_pylist() for c in ("batch", "codes", "counts"))):
                codes, counts = np.cumsum(unpacked(codes, np.int64)), unpacked(counts, np.uint32)
                shard = _shard(codes, shards)
                order = np.argsort(shard, kind="stable")
                met, edge = np.unique(shard[order], return_index=True)
                rows = list(zip(met.tolist(), np.split(order, edge[1:]))) if len(codes) else []
                yield pa.RecordBatch.from_pydict({
                    "batch": pa.array([batch] * len(rows), pa.int64()), "shard": pa.array([i for i, _ in rows], pa.int32()),
                    "codes": pa.array([packed(np.diff(codes[at], prepend=0)) for _, at in rows], pa.binary()),
                    "counts": pa.array([packed(counts[at]) for _, at in rows], pa.binary()),
                })

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """Documents that hold each pair of a shard, for each batch in the order it asked; on one row the most of each A id."""
    batch, shard, blobs, counted = (rows.column(c).to_pylist() for c in ("batch", "shard", "codes", "counts"))
    codes = [np.cumsum(unpacked(c, np.int64)) for c in blobs]
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(place, np.concatenate([unpacked(c, np.uint32) for c in counted]), len(found)).astype(np.int64)
    a = found >> 32
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    edge = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    top = pa.StructArray.from_arrays([pa.array(a[first], pa.int32()), pa.array(np.maximum.reduceat(total, first))], ["a", "most"])
    return pa.table({
        "batch": pa.array(batch, pa.int64()), "shard": pa.array(shard, pa.int32()),
        "totals": pa.array([packed(total[place[i:j]]) for i, j in zip(edge[:-1], edge[1:])], pa.binary()),
        "top": pa.ListArray.from_arrays(pa.array([0, *[len(top)] * len(batch)], pa.int32()), top),
    })


def _finish(shards: int, best: np.ndarray):
    def run(linked: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in linked.to_pylist():
            codes = np.cumsum(unpacked(row["codes"], np.int64))
            order = np.argsort(_shard(codes, shards), kind="stable")
            total = np.zeros(len(codes), np.int64)
            answered = sorted((r["shard"], r["totals"]) for r in answers.to_pylist())
            total[order] = np.concatenate([unpacked(t, np.int64) for _, t in answered] or [np.zeros(0, np.int64)])
            place = np.cumsum(unpacked(row["place"], np.int32).astype(np.int64))
            n, sizes = unpacked(row["n"], np.uint32).astype(np.int64), unpacked(row["sizes"], np.uint32).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            is_best = total == best[codes >> 32] if len(codes) else np.zeros(0, bool)
            sums = [np.concatenate([[0], np.cumsum(x)])[edge] for x in (n * is_best[place], n * total[place])]
            docs = unbundled(row["docs"])
            out.append(pa.table({
                "doc_id": docs.column("doc_id"), **{c: docs.column(c) for c in NUMBERS}, "n_best": pa.array(np.diff(sums[0]), pa.int64()),
                "count_sum": pa.array(np.diff(sums[1]), pa.int64()), "groups_sha256": docs.column("groups_sha256"),
            }))
        return pa.concat_tables(out) if out else pa.table({
            **{c: pa.array([], pa.int64()) for c in ("doc_id", *NUMBERS, "n_best", "count_sum")}, "groups_sha256": pa.array([], pa.string()),
        })

    return run


def align_texts(
    docs: DataFrame, first: str, second: str, *, batch: int = BATCH, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Token groups and links of two tokenizers over each text: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``first`` is the file of a byte-level BPE, which gets a blank and the text; ``second`` that of a piece
    model, which puts the blank itself. All tokens are byte intervals. Sorted by start, with the running
    maximum of their ends, they fall into groups where both end; in a group, all pairs whose intervals
    overlap are links. A pair of ids counts the texts that hold it linked; ``n_best`` are links whose pair has
    the highest count of its A id, ties included, ``count_sum`` is the sum over links of their counts.

    Counts cover the whole corpus: each batch of texts sends its distinct pairs to the shards of their hashes
    and gets totals back. The highest count of each A id, a row per id of the vocabulary at most, is all
    that reaches the driver. Null and empty texts, and texts that either tokenizer doesn't give back byte
    for byte, have no tokens: zeros and an empty hash. Rows that repeat an id or a text are texts of their
    own. Null id: kept. Empty table: no rows. Other columns are ignored. Long texts are cut for the second
    tokenizer before blanks, where none of its pieces reaches across.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(n_bytes / shard))
    batches = cut_lineage(linked(rows, first, second, batch), "linked")
    asked = batches.select("batch", "codes", "counts").mapInArrow(_ask(shards), "batch long, shard int, codes binary, counts binary")
    answers = cut_lineage(asked.groupBy("shard").applyInArrow(
        _answer, "batch long, shard int, totals binary, top array<struct<a: int, most: long>>"
    ), "totals")
    top = answers.select(F.inline("top")).groupBy("a").agg(F.max("most").alias("most")).toArrow()
    a, most = (np.asarray(top.column(c).combine_chunks(), np.int64) for c in ("a", "most"))
    best = np.zeros(int(a.max()) + 1 if len(a) else 1, np.int64)
    best[a] = most
    return batches.drop("counts").groupBy("batch").cogroup(answers.select("batch", "shard", "totals").groupBy("batch")).applyInArrow(
        _finish(shards, best),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
