"""Memory of scoring a batch of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textsignal.llm import lm
from textsignal.llm.elias_fano import EliasFano


def asked_alone(grams, shards=8):
    """Answers to a batch that is the whole corpus."""
    answers = []
    for n in (1, 2, 3):
        at = grams.starts(n)
        keys, _, number = grams.distinct(at, n)
        rows = pa.table(lm._asked(0, n, keys, grams.learned(at, number, len(keys)), shards), pa.schema(lm.ASKED_ARROW))
        for shard in range(shards):
            own = rows.filter(pc.equal(rows.column("shard"), shard))
            if len(own):
                answers.append(lm._answer(own))
    return pa.concat_tables(answers)


def test_a_batch_is_scored_in_bounded_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, 2000) % 5000) for _ in range(100)]
    grams = lm.Grams(pa.table({"text": texts, "held_out": [i % 7 == 2 for i in range(100)]}))
    answers = asked_alone(grams)
    words = answers.filter(pc.equal(answers.column("level"), 1))
    sizes = (pc.sum(words.column(c)).as_py() for c in ("n_tokens", "n_distinct"))
    tracemalloc.start()
    try:
        found = lm.score(grams, answers, *sizes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found["score"]) == 100 and np.isfinite(found["score"]).all()
    assert peak < 125 * len(grams.hash)


def test_low_bits_of_more_than_a_slice():
    for low in (1, 13, 63):
        rng = np.random.default_rng(low)
        values = np.sort(rng.integers(0, 1 << 63, 150_001, dtype=np.uint64) >> np.uint64(63 - min(low + 17, 63)))
        sequence = EliasFano(values, int(values[-1]) + 1)
        assert (sequence.values() == values).all()
        assert (sequence.access(np.arange(0, len(values), 7)) == values[::7]).all()
