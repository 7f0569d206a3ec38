"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.llm.common import chunks, joined, pick, remainder, renamed

GRAMS = (1, 2, 3, 4)  # bytes in a subword
BITS = 14  # of a subword's bucket
CLEAR = 0.5  # a calibrated prediction at least this likely is never rejected
UNKNOWN = "und"
LETTER = r"\p{L}"


def subwords(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each subword length: the buckets of all subwords, and the places where the texts' subwords start.

    Subwords don't cross texts. Each length has its own hash.
    """
    wide = data.astype(np.uint32)
    value = np.zeros(len(data), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        value[:max(0, len(data) - n + 1)] |= wide[n - 1:] << np.uint32(8 * (n - 1))
        if n in GRAMS:
            bucket = (value ^ np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            bucket ^= bucket >> np.uint32(15)
            bucket = (bucket * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            count = np.maximum(np.diff(at) - n + 1, 0)
            inside = np.ones(len(data), bool)
            for back in range(1, n):
                inside[(at[1:] - back)[at[1:] - back >= at[:-1]]] = False
            yield bucket[inside], np.concatenate([[0], np.cumsum(count)])


def totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 where a text has none."""
    out = np.zeros(len(at) - 1, np.float64)
    filled = np.flatnonzero(at[1:] > at[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, at[:-1][filled], dtype=np.float64)
    return out


@dataclass
class Model:
    """``table[bucket, language]`` is a bucket's embedding times the softmax weights.

    Averaging and the linear layer commute, so a text's logits are the mean of its subwords'
    rows. ``sharpness`` is the inverse temperature and ``least`` the score below which a
    prediction is rejected.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    sharpness: float = 1.0
    least: float = 0.0

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums, n = np.zeros((len(at) - 1, len(self.languages))), np.zeros(len(at) - 1)
        for bucket, places in subwords(data, at):
            n += np.diff(places)
            for i in range(len(self.languages)):
                sums[:, i] += totals(self.table[i].take(bucket), places)
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        e = np.exp(self.sharpness * (logits - logits.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray, str]], *, dims: int = 8, epochs: int = 6, steps: int = 600, rate: float = 0.1, batch: int = 32,
    reject: float = 0.001, seed: int = 5,
) -> Model:
    """Fit embeddings and softmax by stochastic gradient descent on rows of (buckets, weights, language).

    Each parameter's step is divided by the root of its summed squared gradients (Adagrad), as rare
    subwords get few and small ones. There are ``epochs`` passes, and more until ``steps`` steps are done.
    A fifth of the rows is held back: on it the temperature is chosen by log loss, and the
    rejection threshold as the ``reject`` quantile of the scores of right predictions, less a
    tenth, and ``CLEAR`` at most. Without rows the model knows no language; with one, it always predicts it.
    """
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(r[2]) for r in rows])
    order = rng.permutation(len(rows))
    fit, kept = (order[len(rows) // 5:], order[:len(rows) // 5]) if len(rows) >= 10 else (order, order)
    embed = rng.uniform(-1 / dims, 1 / dims, (1 << BITS, dims)).astype(np.float32)
    soft, bias = np.zeros((dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    past = [np.full(x.shape, 1e-12, np.float32) for x in (embed, soft, bias)]
    for _ in range(max(epochs, -(-steps * batch // len(fit)))):
        for part in np.array_split(rng.permutation(fit), -(-len(fit) // batch)):
            bucket = np.concatenate([rows[i][0] for i in part])
            weight = np.concatenate([rows[i][1] for i in part])[:, None]
            n = np.array([len(rows[i][0]) for i in part])
            mean = np.add.reduceat(embed[bucket] * weight, np.cumsum(n) - n)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), label[part]] -= 1
            p /= len(part)
            back = np.repeat(p @ soft.T, n, axis=0) * weight
            met = np.unique(bucket)
            sums = np.stack([np.bincount(bucket, back[:, d], 1 << BITS)[met] for d in range(dims)], 1).astype(np.float32)
            for x, g, seen, at in ((embed, sums, past[0], met), (soft, mean.T @ p, past[1], slice(None)), (bias, p.sum(0), past[2], slice(None))):
                seen[at] += g * g
                x[at] -= rate * g / np.sqrt(seen[at])
    model = Model(languages, np.ascontiguousarray((embed @ soft).T), bias.astype(np.float64))
    z = np.array([(model.table[:, rows[i][0]] * rows[i][1]).sum(1) for i in kept]) + model.bias
    y = label[kept]

    def loss(sharpness: float) -> float:
        scaled = sharpness * (z - z.max(1, keepdims=True))
        return float((np.log(np.exp(scaled).sum(1)) - scaled[np.arange(len(y)), y]).mean())

    model.sharpness = min(np.geomspace(0.1, 10, 41), key=loss)
    right = z.argmax(1) == y
    if right.any():
        model.least = min(CLEAR, 0.9 * float(np.quantile(model.scores(z)[right].max(1), reject)))
    return model


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return joined(pc.utf8_lower(pc.fill_null(texts, "")))


def _histograms(batches):
    for b in batches:
        data, at = _lower(b.column("text"))
        made = []
        for i in range(len(at) - 1):
            parts = [x for x, _ in subwords(data[at[i]:at[i + 1]], at[i:i + 2] - at[i])]
            n = np.bincount(np.concatenate(parts) if parts else [], minlength=1 << BITS)
            bucket = np.flatnonzero(n)
            made.append((bucket.astype(np.int16), (n[bucket] / max(1, n.sum())).astype(np.float32)))
        yield pa.RecordBatch.from_arrays(
            [b.column("place"), pa.array([m[0] for m in made], pa.list_(pa.int16())),
             pa.array([m[1] for m in made], pa.list_(pa.float32())), b.column("lang")],
            ["place", "bucket", "weight", "lang"],
        )


def fit(labelled: DataFrame, train_rows: int = 1024, **settings) -> Model:
    """A model from a sample of rows with text and language.

    ``train_rows`` bounds the sample: the rows with the smallest hashes of id and text. Their whole
    texts become histograms over 2**``BITS`` buckets on the executors; only those reach the driver.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).withColumn("place", F.xxhash64("id"))
    cut = rows.select("place").orderBy("place").limit(train_rows).agg(F.max("place")).first()[0]
    if cut is None:
        return train([], **settings)
    sample = (
        rows.filter(F.col("place") <= cut).select("place", "text", "lang")
        .mapInArrow(_histograms, "place long, bucket array<short>, weight array<float>, lang string").limit(2 * train_rows)
        .toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
    )
    bucket, weight = (sample.column(c).combine_chunks() for c in ("bucket", "weight"))
    return train([
        (np.asarray(bucket[i].values).astype(np.int64), np.asarray(weight[i].values), lang)
        for i, lang in enumerate(sample.column("lang").to_pylist())
    ], **settings)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``lang_pred``, ``score`` and ``rejected`` beside all columns, whose names must differ from these and each other."""
    fields = docs.schema.fields
    names = [f.name for f in fields]
    handle = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS rows of one number a language

    def label(batches):
        model = handle.value
        known = np.array([*model.languages, UNKNOWN], object)
        for b in batches:
            texts = pc.fill_null(b.column(text), "")
            data, at = _lower(texts)
            score, best = np.zeros(len(at) - 1), np.full(len(at) - 1, len(model.languages))
            lettered = np.asarray(pc.match_substring_regex(texts, LETTER))
            if model.languages:
                for low, high in chunks(at):
                    p = model.scores(model.logits(data[at[low]:at[high]], at[low:high + 1] - at[low]))
                    best[low:high], score[low:high] = p.argmax(1), p.max(1)
            best[~lettered], score[~lettered] = len(model.languages), 0.0
            gone = (best == len(model.languages)) | (score < model.least)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(known[best], pa.string()), pa.array(score), pa.array(gone)],
                [*names, "lang_pred", "score", "rejected"],
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(label, f"{columns}, lang_pred string, score double, rejected boolean")


def identify(
    docs: DataFrame, *, folds: int = 4, held: int = 2, train_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", **settings,
) -> DataFrame:
    """Predicted language of every whole text: ``doc_id, held_out, lang_pred, score, rejected``.

    Only text and language of rows whose crc32 of the id modulo ``folds`` isn't ``held`` are
    learned from; the language, the source and the id are no inputs of a prediction. Texts
    are lower-cased. A text that is null or has no letter is ``und`` with score 0 and
    rejected; other texts get a learned language and a calibrated probability, and are
    rejected below the model's threshold. Equal texts get equal results. Null language: not
    learned from. Null id: its crc32 is that of the empty text. Without labelled rows all
    texts are ``und``. Empty table: no rows. Other columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col)
    held_out = remainder(F.col("id"), folds) == held
    model = fit(rows.filter(~held_out), train_rows, **settings)
    return predict(rows.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "text"), model).drop("text")


def recognised(
    docs: DataFrame, *, train_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings,
) -> DataFrame:
    """The rows that aren't rejected by a model of a sample of all rows, with all their columns, whatever their names."""
    plain, at = renamed(docs)
    rows = plain.select(F.col(at[id_col]).alias("id"), F.col(at[text_col]).alias("text"), F.col(at[lang_col]).alias("lang"))
    found = predict(plain, fit(rows, train_rows, **settings), at[text_col])
    return found.filter("NOT rejected").select(plain.columns).toDF(*docs.columns)
