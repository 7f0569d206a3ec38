"""Language ID, fingerprints, token counts, the tokenizer and language-model scores."""

import hashlib
import math
import random
import unicodedata
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from cases import few_partitions  # noqa: F401
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from textsignal.llm import batches, bytebpe, common, elias_fano, langid, lm, queries, syncmers, token_counts

FOLDER = str(DATA / "sf0.001")


def documents(spark, folder=FOLDER):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@given(st.lists(st.text(alphabet=" \t\nabcÉ😀\x85", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_runs_between_ascii_white_space(texts):
    data, at = common.joined(pa.array(texts, pa.string()))
    h, edge = common.hashed_words(common.LOWER[data], at)
    words = [t.encode().lower().split() for t in texts]
    assert np.diff(edge).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat)))


def test_joined_reads_slices_and_nulls():
    array = pa.array(["skip", "ab", None, "é", ""]).slice(1)
    data, at = common.joined(array)
    assert data.tobytes() == "abé".encode() and at.tolist() == [0, 2, 2, 4, 4]


def test_pick_prefers_the_exact_name(spark):
    df = cases.table(spark)
    assert common.pick(df, t="text").filter("t = 'x'").count() == 0
    assert common.pick(df, t="TEXT").filter("t = 'y'").count() == len(cases.ROWS)
    assert common.pick(df.drop("copy"), t="Doc_Id").columns == ["t"]


# language ID

def test_language_of_held_out_documents(spark):
    found = queries.op8_language_id(spark, FOLDER).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang) and all(r.held_out == (cases.in_fold(r.doc_id, 4) == 2) for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found) and sum(r.rejected for r in found) <= 0.03 * len(found)


def plain_language(model, text):
    """The model's prediction by definition: the mean of the table's rows over all byte n-grams, and a softmax."""
    if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    data = text.lower().encode()
    rows = []
    for n in langid.GRAMS:
        for i in range(len(data) - n + 1):
            h = (int.from_bytes(data[i:i + n], "little") ^ (0x9E3779B9 * n & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0xC2B2AE35 & 0xFFFFFFFF
            rows.append(h >> 32 - langid.BITS)
    logits = [sum(float(model.table[k][b]) for b in rows) / len(rows) + float(model.bias[k]) for k in range(len(model.languages))]
    powers = [math.exp(model.sharpness * (z - max(logits))) for z in logits]
    return model.languages[powers.index(max(powers))], max(powers) / sum(powers)


def test_predictions_equal_the_plain_model(spark, monkeypatch):
    made = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a, **b: made.append(fit(*a, **b)) or made[-1])
    found = {r.doc_id: r for r in queries.op8_language_id(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    short = sorted(texts, key=lambda i: len(texts[i] or ""))[:120]
    for i in short:
        lang, score = plain_language(made[0], texts[i])
        assert found[i].lang_pred == lang and found[i].score == pytest.approx(score, abs=1e-6)
        assert found[i].rejected == (lang == "und" or found[i].score < made[0].least)


def test_language_never_comes_from_held_out_rows(spark):
    rows = [(i, f"foo bar baz {i}", "zz" if cases.in_fold(i, 4) == 2 else "yy", "s") for i in range(40)]
    assert {r.lang_pred for r in langid.identify(cases.table(spark, rows)).collect()} == {"yy"}


def test_language_of_awkward_rows(spark):
    found = langid.identify(cases.table(spark)).collect()
    assert len(found) == len(cases.ROWS)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (3, 4, 5, 6))
    assert by[1].lang_pred != "und" and (by[1].lang_pred, by[1].score) == (by[2].lang_pred, by[2].score)
    assert langid.identify(cases.empty(spark)).collect() == []
    unlabelled = [(1, "some words", None, "s")]
    assert [r.lang_pred for r in langid.identify(cases.table(spark, unlabelled)).collect()] == ["und"]
    assert langid.recognised(cases.table(spark)).columns == cases.table(spark).columns


def test_subwords_stay_in_their_text():
    one = pa.array(["abc", "", "d"])
    data, at = common.joined(one)
    for n, (bucket, places) in zip(langid.GRAMS, langid.subwords(data, at)):
        assert np.diff(places).tolist() == [max(0, 4 - n), 0, max(0, 2 - n)] and len(bucket) == places[-1]


# fingerprints

def plain_syncmers(text):
    """By definition: k-mers with a smallest inner substring at an edge, from the same hashes of code points."""
    k, s = syncmers.K, syncmers.INNER

    def h(part):
        total = 0
        for i, c in enumerate(part):
            total += (ord(c) + 1) * pow(syncmers._BASE, i, 1 << 64)
        return int(common.mix(np.array([total % (1 << 64)], np.uint64))[0])

    out = []
    for i in range(len(text) - k + 1):
        inner = [h(text[j:j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(text[i:i + k])))
    return out


def test_syncmers_by_definition():
    rng = random.Random(3)
    for n in (15, 16, 17, 40, 90):
        text = "".join(rng.choice("ab é😀") for _ in range(n))
        place, anchor = syncmers.syncmers(text)
        if n < syncmers.K:
            assert len(anchor) == 1
        else:
            assert list(zip(place.tolist(), anchor.tolist())) == plain_syncmers(text)


def test_syncmers_are_context_free():
    passage = "a passage that stands in two different texts, long enough for many anchors"
    inside = set(syncmers.syncmers(passage)[1].tolist())
    assert len(inside) > 5 and inside <= set(syncmers.syncmers("Some words before. " + passage + " And after.")[1].tolist())


def test_likeness_follows_jaccard():
    rng = random.Random(4)
    for share in (0.2, 0.5, 0.8):
        a = "".join(rng.choice("abcdefgh ") for _ in range(6000))
        b = a[:int(6000 * share)] + "".join(rng.choice("ijklmnop ") for _ in range(6000 - int(6000 * share)))
        x, y = (set(syncmers.syncmers(t)[1].tolist()) for t in (a, b))
        true = len(x & y) / len(x | y)
        assert abs(syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) - true) < 0.2


def check_fingerprints(found, rows):
    """Rows in ascending id, then text; each with the next one, the last with the first."""
    order = sorted(((syncmers._NONE if k is None else k, t or "") for k, t in rows))
    want = []
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        other = text[:len(text) - half] + following[:half]
        f, g, h = (syncmers.fingerprint(x) for x in (text, other, following))
        want.append((
            None if key == syncmers._NONE else key, len(text), hashlib.sha256(other.encode()).hexdigest(),
            syncmers._printed(f), syncmers._printed(g), syncmers.likeness(f, g), syncmers.likeness(f, h),
        ))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in found)


def test_fingerprints_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS", 17)
    found = queries.op4_fingerprints(spark, FOLDER).collect()
    check_fingerprints(found, documents(spark).items())
    assert sum(r.near_edited > r.near_next for r in found) > 0.9 * len(found)


def test_fingerprints_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS", 5)
    check_fingerprints(syncmers.fingerprints(cases.table(spark)).collect(), [r[:2] for r in cases.ROWS])
    check_fingerprints(syncmers.fingerprints(cases.table(spark, cases.ROWS[:1])).collect(), [cases.ROWS[0][:2]])
    assert syncmers.fingerprints(cases.empty(spark)).collect() == []


# token counts

@pytest.fixture(scope="module")
def pieces():
    return token_counts.Pieces(token_counts.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken")))


def plain_count(text, pieces):
    data, at = common.joined(pa.array([text]))
    start, end, _ = token_counts.pre_tokens(data, at)
    made = [token_counts.segment(data[a:b].tobytes(), pieces) for a, b in zip(start, end)]
    return sum(n for _, n in made), len(made), sum(s for s, _ in made)


def test_token_counts_equal_the_plain_recurrence(spark, pieces):
    found = {r.doc_id: r for r in queries.op9_token_counts(spark, FOLDER).collect()}
    texts = documents(spark)
    assert set(found) == set(texts)
    for key in list(texts)[:60]:
        n, runs, score = plain_count(texts[key], pieces)
        assert (found[key].n_tokens, found[key].n_pretokens) == (n, runs) and found[key].score == score / 1e6


def test_token_counts_of_awkward_rows(spark, pieces):
    made = token_counts.count_tokens(cases.table(spark), queries.vocabulary("byte_bpe_50k.tiktoken")).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in made) == sorted(
        (repr(k), plain_count(t or "", pieces)[0]) for k, t, *_ in cases.ROWS)
    assert token_counts.count_tokens(cases.empty(spark), queries.vocabulary("byte_bpe_50k.tiktoken")).collect() == []


def test_pre_tokens_join_up_to_the_text():
    for text in ("a  b\n\n c1é!? x", " ", "", "one two"):
        data, at = common.joined(pa.array([text]))
        start, end, _ = token_counts.pre_tokens(data, at)
        assert b"".join(data[a:b].tobytes() for a, b in zip(start, end)) == text.encode()


def test_a_vocabulary_must_cover_all_bytes():
    with pytest.raises(ValueError, match="no piece"):
        token_counts.Pieces({b"a": 0})


# the tokenizer

def test_ids_equal_those_of_the_tokenizer(spark):
    path = queries.tokenizer()
    own = bytebpe.tokenizer(path)
    rng = random.Random(1)
    letters = "ab s'tredlmv  \n\t\r.,!1½é\xa0　́中'’'SLL\x85\x1c😀͸ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>x", "'store", "don't!'s", "  'll", "''re", "", *list(documents(spark).values())[:50]]
    for text, ids in zip(texts, bytebpe.encode(texts, path)):
        assert own.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    path, texts = queries.tokenizer(), [f"word{i} other{i * 7}" for i in range(300)]
    want = [x.tolist() for x in bytebpe.encode(texts, path)]
    monkeypatch.setattr(bytebpe, "REMEMBERED", 50)
    monkeypatch.setattr(bytebpe, "RECENT", 20)
    monkeypatch.setattr(bytebpe, "GATHER", 100)
    assert [x.tolist() for x in bytebpe.encode(texts, path)] == want


# language-model scores

@given(st.lists(st.integers(0, 400), max_size=60), st.integers(1, 64))
@settings(max_examples=80, deadline=None)
def test_elias_fano_finds_successors(values, spare):
    values = sorted(values)
    found = elias_fano.EliasFano(np.array(values, np.uint64), 400 + spare)
    if values:
        assert found.access(np.arange(len(values))).tolist() == values
    assert found.values().tolist() == values
    asked = np.arange(400 + spare, dtype=np.uint64)
    low, high = len(values) // 4, len(values) - len(values) // 5
    at, there = found.successor(asked, np.full(len(asked), low), np.full(len(asked), high))
    for x, place, hit in zip(asked.tolist(), at, there):
        assert hit == (x in values[low:high]) and (not hit or values[place] == x)


@given(st.lists(st.integers(0, 1 << 63), max_size=50))
def test_packed_numbers_come_back(values):
    assert batches.unpacked(batches.packed(np.array(values, np.uint64)), np.uint64).tolist() == values


def plain_scores(rows):
    """Counts and smoothed probabilities by definition."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for (key, _), w in zip(rows, tokens):
        if cases.in_fold(key, 7) != 2:
            one.update(w)
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    prior = lambda c, order: float(lm._prior(np.array([c]), order)[0])
    out = []
    for (key, _), w in zip(rows, tokens):
        base = total = 0.0
        for i, a in enumerate(w):
            p = (one[a] + 1) / (n + v + 1)
            base += math.log10(p)
            if i and (c := one[w[i - 1]]):
                p = (two[w[i - 1], a] + prior(c, 2) * p) / (c + prior(c, 2))
            if i > 1 and (c := two[w[i - 2], w[i - 1]]):
                full = three[w[i - 2], w[i - 1], a]
                p = ((full if full >= lm.LEAST else 0) + prior(c, 3) * p) / (c + prior(c, 3))
            total += math.log10(p)
        out.append((key, cases.in_fold(key, 7) == 2, len(w), sum(one[a] > 0 for a in w), n, base, total))
    return out


def check_scores(found, rows):
    want = sorted(plain_scores(rows), key=lambda r: repr(r[:4]))
    found = sorted(map(tuple, found), key=lambda r: repr(r[:4]))
    assert [r[:5] for r in want] == [r[:5] for r in found]
    for a, b in zip(sorted(want, key=lambda r: (repr(r[:4]), r[5])), sorted(found, key=lambda r: (repr(r[:4]), r[5]))):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and abs(a[6] - b[6]) <= 2.5e-4 * a[2]


def test_scores_over_batches(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = lm.score_texts(docs, batch=60_000).collect()
    check_scores(found, list(documents(spark).items()))
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_awkward_rows(spark):
    check_scores(lm.score_texts(cases.table(spark), batch=500).collect(), [r[:2] for r in cases.ROWS])
    assert lm.score_texts(cases.empty(spark)).collect() == []
    alone = [(next(k for k in range(99) if cases.in_fold(k, 7) == 2), "held out alone", "en", "s")]
    check_scores(lm.score_texts(cases.table(spark, alone)).collect(), [alone[0][:2]])


def test_trigrams_of_one_occurrence_count(spark):
    keys = [next(k for k in range(99) if (cases.in_fold(k, 7) == 2) is held) for held in (False, True)]
    rows = [(k, "red green blue", "en", "s") for k in keys]
    found = {r.held_out: r for r in lm.score_texts(cases.table(spark, rows)).collect()}
    # four words of one occurrence: 2/9 each, (1 + 3 * 2/9) / (1 + 3) = 5/12 after one word, (1 + 5/12) / 2 = 17/24 after two
    want = math.log10(2 / 9) + math.log10(5 / 12) + 2 * math.log10(17 / 24)
    assert found[True].score == pytest.approx(want, abs=1e-3) and found[False].score == pytest.approx(want, abs=1e-3)
