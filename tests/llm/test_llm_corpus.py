"""Mixing, packing, top-k search, near duplicates, repeats, line templates and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest
from cases import few_partitions  # noqa: F401
from compare import compare, connect
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from textsignal.llm import bwt, bytebpe, common, components, line_dedup, mixing, ngram_join, packing, queries, repeats, topk

FOLDER = str(DATA / "sf0.001")


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix", "pack"]


# mixing

def plain_poisson(u, mean):
    p = cdf = math.exp(-mean)
    n = 0
    while cdf <= u and n < 5000:
        n += 1
        p *= mean / n
        cdf += p
    return n


def test_poisson_inversion(spark):
    rng = random.Random(2)
    rows = [(rng.random(), mean) for mean in (0.01, 0.5, 1.0, 7.3, 120.0, 499.0) for _ in range(40)] + [(0.0, 1.0), (mixing.MOST, 500.0)]
    df = spark.createDataFrame(rows, "u double, mean double")
    for r in df.select("u", "mean", mixing.poisson(F.col("u"), F.col("mean")).alias("n")).collect():
        assert r.n == plain_poisson(r.u, r.mean)


def test_sources_reach_their_weights(spark):
    rows = [(i, "some text of a size " * (1 + i % 3), "en", "hot" if i % 3 else f"s{i % 2}") for i in range(4000)]
    mixed = mixing.mix_sources(cases.table(spark, rows), {"hot": 1.0, "s0": 2.0}, default_weight=1.0)
    sizes = dict(mixed.groupBy("source").agg(F.sum(F.octet_length("c1") + 1) if "c1" in mixed.columns else F.sum("n_chars")).collect())
    total = sum(sizes.values())
    assert abs(sizes["hot"] / total - 0.25) < 0.03 and abs(sizes["s0"] / total - 0.5) < 0.04
    per_copy = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in per_copy)


def test_large_rates_are_sums_of_parts(spark):
    rows = [(1, "x", "en", "tiny"), *((i, "y" * 5000, "en", "big") for i in range(2, 8))]
    found = mixing.mix_sources(cases.table(spark, rows), {"tiny": 1.0, "big": 1.0}).filter("source = 'tiny'").count()
    assert 5000 < found < 10_500  # a mean of 7,503


def test_mixing_awkward_rows(spark):
    df = cases.table(spark)
    mixed = mixing.mix_sources(df, {"a": 1.0}, epochs=6.0)
    assert mixed.columns == [c for c in df.columns if c != "copy"] + ["copy", "shuffle_key"]
    first, again = (sorted(map(repr, m.collect())) for m in (mixed, mixing.mix_sources(df.repartition(5), {"a": 1.0}, epochs=6.0)))
    assert first == again and {r.source for r in mixed.select("source").collect()} <= {"a", "b", "c", None}
    assert mixing.mix_sources(df, {"a": 0.0, "b": 1.0}, default_weight=0.0).filter("source <=> 'a' OR source IS NULL").count() == 0
    assert mixing.mix_sources(cases.empty(spark), {"a": 1.0}).collect() == []


# packing

def check_packed(found, rows, window=packing.WINDOW):
    """Exact pieces, gapless sequences within the window, little padding."""
    texts = [t or "" for _, t in rows]
    ids = [np.append(x, np.uint32(packing.END)).astype("<u4") for x in bytebpe.encode(texts, queries.tokenizer())]
    want = Counter()
    for (key, _), own in zip(rows, ids):
        for start in range(0, len(own), window):
            part = own[start:start + window]
            want[key, start, len(part), zlib.crc32(part.tobytes()), len(own)] += 1
    assert want == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(map(len, ids)) / (window * max(1, len(sequences)))


def test_packing_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 16)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert check_packed(queries.op5_pack(spark, FOLDER).collect(), rows) > 0.95


def test_packing_awkward_rows(spark):
    check_packed(packing.pack(cases.table(spark), queries.tokenizer()).collect(), [r[:2] for r in cases.ROWS])
    assert packing.pack(cases.empty(spark), queries.tokenizer()).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
@settings(max_examples=50, deadline=None)
def test_recipes_use_up_the_histogram(histogram):
    used = Counter()
    for column, times in packing.recipes(histogram, 64):
        assert times > 0 and sum(column) <= 64
        for n in column:
            used[n] += times
    assert dict(used) == histogram


def test_solver_fits_a_histogram_that_can_be_filled():
    columns = packing.combinations([100, 300, 624, 400, 512], 1024)
    assert (512, 512) in columns and (624, 300, 100) in columns
    histogram = {100: 50, 300: 50, 624: 50, 512: 20}
    x = packing.solve(columns, histogram)
    left = Counter(histogram)
    for c, k in zip(columns, x):
        for n in c:
            left[n] -= k
    assert min(x) >= 0 and max(map(abs, left.values())) < 1


# top-k search

def check_top(found, rows, asked, k):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, vector in {(i, tuple(v)) for i, v in sound if asked(i)}:
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in sound if i != q)
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    assert sorted(want) == sorted(map(tuple, found))


def test_top_k_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 60)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "SLICE", 1)
    rng = random.Random(5)
    rows = [(i, [rng.choice((0.0, 0.5, -0.25, 0.001)) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_top(topk.top_k(df, F.col("vec_id") % 20 == 0, 4).collect(), [(i, [float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 20 == 0, 4)


def test_top_k_of_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]),
        (6, []), (7, [3.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (100, [1.0, -1.0]), (100, [1.0, -1.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, w int, VEC_ID string")
    check_top(topk.top_k(df, F.col("vec_id") % 100 == 0).collect(), rows, lambda i: i % 100 == 0, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert topk.top_k(df.filter("w = 1").limit(0).unionAll(df.limit(0)), F.col("vec_id") % 100 == 0).collect() == []


# near duplicates

def check_links(found, rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    rows = [rows[i] for i in order]
    links, root = cases.near([t for _, t in rows])
    want = sorted(repr((k, rows[r][0], n)) for (k, _), r, n in zip(rows, root, links))
    assert want == sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in found)


def test_links_over_blocks(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    check_links(ngram_join.join(documents(spark), block=700).collect(), rows)


def test_links_of_a_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(80), i % 4):
            words[at] = f"e{rng.randrange(10)}"
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(200 + i, " ".join(f"u{i}x{j}" for j in range(30)), "en", "s") for i in range(20)]
    found = ngram_join.join(cases.table(spark, rows), block=2000).collect()
    check_links(found, [r[:2] for r in rows])
    assert max(r.n_links for r in found) > 50


def test_links_of_awkward_rows(spark):
    found = ngram_join.join(cases.table(spark)).collect()
    check_links(found, [r[:2] for r in cases.ROWS])
    assert {r.n_copies for r in found if r.doc_id in (8, 9)} == {2}
    assert ngram_join.join(cases.empty(spark)).collect() == []


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.9, 0.99)):
        n, rows = ngram_join.bands(threshold, recall)
        assert 1 - (1 - threshold ** rows) ** n >= recall and n * rows <= ngram_join.HASHES
    with pytest.raises(ValueError, match="recall"):
        ngram_join.bands(0.05, 0.9999)


def test_overlaps_by_products(monkeypatch):
    monkeypatch.setattr(ngram_join, "WIDTH", 3)
    sets = [{1, 2, 3}, {2, 3, 4, 5, 9}, set(), {1, 2, 3, 4, 5, 6, 7}, {8}]
    gram = np.array([x for s in sets for x in sorted(s)], np.uint64)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    both = np.array([[len(a & b) for b in sets] for a in sets])
    whole = ngram_join.overlaps(gram, at)
    off = ~np.eye(5, dtype=bool)
    assert (whole[off] == both[off]).all()
    assert (ngram_join.overlaps(gram, at, 2) == both[:2, 2:]).all()


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(30)]
    edges = chain + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)] + [(-5, 200), (7, 7)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {x: r for x, r in root.items() if x != r}


# repeats

@given(st.lists(st.text(alphabet="ab\0", max_size=14), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_merged_transform_sorts_rotations(texts):
    data, at = common.joined(pa.array(texts))
    strings = bwt.Strings.of(data, at)
    place, new = bwt.intervals(strings, 8)

    def rotation(p):
        i = int(np.searchsorted(strings.at, p, "right")) - 1
        own = strings.data[strings.at[i]:strings.at[i + 1]].tobytes()
        q = p - strings.at[i]
        return ((own[q:] + own[:q]) * 8)[:8]

    found = [rotation(p) for p in place.tolist()]
    assert sorted(place.tolist()) == list(range(len(strings.data))) and found == sorted(found)
    assert [i == 0 or a != found[i - 1] for i, a in enumerate(found)] == new.tolist()


def check_kept(found, rows, length):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for (key, text), gone in zip(order, cases.repeated([t for _, t in order], length)):
        b = (text or "").encode()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in found)


@pytest.mark.parametrize(("hot", "block"), [(200, 1 << 20), (2, 3000)])
def test_repeats_over_batches_shards_and_blocks(spark, monkeypatch, hot, block):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    check_kept(repeats.dedup(documents(spark), batch=60_000, shard=100_000, block=block).collect(), rows, 100)


def test_repeats_of_awkward_rows(spark):
    for length in (100, 32):
        check_kept(repeats.dedup(cases.table(spark), length=length, batch=700).collect(), [r[:2] for r in cases.ROWS], length)
    assert repeats.dedup(cases.empty(spark)).collect() == []
    shown = {r.doc_id: r.kept for r in repeats.dedup(cases.table(spark), texts=True).collect()}
    assert shown[1] == cases.ROWS[0][1] and shown[3] == "" and len(shown[11]) < 200
    with pytest.raises(ValueError, match="length"):
        repeats.dedup(cases.table(spark), length=30)


def test_long_texts_are_searched_in_parts(monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 500)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(4000))
    data, at = common.joined(pa.array(["short", text]))
    found = repeats.fragments(data, at, 100)
    windows = sorted(p for low, n in zip(found["low"].tolist(), found["n"].tolist()) for p in range(low, low + n))
    assert windows == list(range(3901)) and set(found["doc"].tolist()) == {1}


def test_runs_are_joined():
    doc, low, n = repeats.joined_runs(*(np.array(x) for x in ([1, 0, 1, 1], [5, 3, 0, 30], [4, 2, 5, 1])))
    assert list(zip(doc.tolist(), low.tolist(), n.tolist())) == [(0, 3, 2), (1, 0, 9), (1, 30, 1)]


# line templates

def check_lines(found, rows):
    gone = cases.recurring(rows, line_dedup.DEPTH, line_dedup.MIN_TOKENS, line_dedup.MIN_DOCS, line_dedup.CONSTANT)
    want = [
        (k, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g), 0 if t is None else t.count("\n") + 1, len(g))
        for (k, t), g in zip(rows, gone)
    ]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in found)


def test_line_templates_by_definition(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = queries.op10_line_dedup(spark, FOLDER).collect()
    check_lines(found, rows)
    assert sum(r.n_dropped for r in found) > 0


def test_line_templates_generalise_variable_fields(spark):
    rows = [(i, f"posted on {i} May by user {'abcdefghij'[i]} in the public news section\nown words of document {'klmnopqrst'[i]} alone {i}", "en", "s") for i in range(9)]
    rows += [(20, "posted on 5 May by user z in the public news section but much longer", "en", "s"), (21, "a b", "en", "s")]
    found = line_dedup.dedup(cases.without_clash(spark, rows)).collect()
    check_lines(found, [r[:2] for r in rows])
    assert sorted(r.n_dropped for r in found) == [0, 0, 0] + [1] * 8
    plain = cases.table(spark, rows).select(F.col("doc_id").alias("key"), line_dedup.identity(F.col("doc_id"), F.col("key")).alias("uid"), F.lit("x y 1").alias("text"))
    _, made = line_dedup.templates(plain)
    assert [tuple(r) for r in made.select("pattern", "docs").collect()] == [("x y <*>", len(rows))]


def test_line_templates_of_awkward_rows(spark):
    rows = [*cases.ROWS, *((50 + i, "one two three four\n\nx", "en", "a") for i in range(5))]
    df = cases.table(spark, rows)
    kept = cases.without_clash(spark, rows)
    check_lines(line_dedup.dedup(kept).collect(), [r[:2] for r in rows])
    assert line_dedup.dedup(df).columns == [*df.columns, "n_lines", "n_dropped"]
    assert line_dedup.dedup(cases.empty(spark)).collect() == []


def test_short_lines_are_dropped(spark):
    lines = ["Les."] * 4 + ["And ornd."] * 4 + ["And once."] * 3 + ["Les"]
    rows = [(i, f"{line}\nown{'abcdefghijklmnop'[i]}", "en", "s") for i, line in enumerate(lines)]
    found = sorted(line_dedup.dedup(cases.without_clash(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [r.n_dropped for r in found] == [0, 1, 1, 1, 0, 1, 1, 1] + [0] * 4
    assert found[1].text == "ownb"


def test_lines_without_blanks_are_dropped(spark):
    lines = ["版权所有翻印必究"] * 4 + [f"第{n}页之前的内容在这里可以看到" for n in (1, 12, 3, 4)] + [f"他去了很远的东{c}" for c in "京南西北"] + ["สงวนลิขสิทธิ์"] * 5
    rows = [(i, line, "zh", "s") for i, line in enumerate(lines)]
    found = sorted(line_dedup.dedup(cases.without_clash(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [r.n_dropped for r in found] == [0, 1, 1, 1] * 2 + [0] * 4 + [0, 1, 1, 1, 1]


def test_short_lines_with_fields_are_dropped(spark):
    lines = [f"(c) {2000 + i} Example Inc" for i in range(4)] + [f"Page {i} of 1{i}" for i in range(4)] + ["Tel. 030 1234 99"] * 4
    lines += ["Tel. 040 5 6"] * 3 + [f"see {c} and 5" for c in "abcd"] + [f"7 8 {i} times" for i in range(4)]
    rows = [(i, line, "en", "s") for i, line in enumerate(lines)]
    found = sorted(line_dedup.dedup(cases.without_clash(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [r.n_dropped for r in found] == [0, 1, 1, 1] * 3 + [0] * 11


def test_lines_under_all_rules_together(spark):
    """Equal to the brute-force version of every rule and constant, on random lines of words, numbers and scripts without blanks."""
    rng = random.Random(12)
    shapes = [
        lambda: f"(c) {rng.randrange(2000, 2030)} Example Inc", lambda: f"Page {rng.randrange(9)} of {rng.randrange(30)}", lambda: f"see {rng.choice('abc')} and {rng.randrange(3)}",
        lambda: "Tel. 030 1234 99", lambda: "版权所有翻印必究", lambda: f"第{rng.randrange(20)}页的内容{rng.choice('甲乙丙丁戊')}", lambda: "all rights reserved by the owner of this page and of the texts on it",
        lambda: f"posted on {rng.randrange(31)} May by {rng.choice(['ann', 'bob', 'cy'])} in the public news section of the town", lambda: " \t", lambda: rng.choice(["Les.", "And ornd.", "x"]),
        lambda: " ".join(rng.choice(["red", "green", "blue", "7"]) for _ in range(rng.randrange(1, 5))), lambda: f"ราคา {rng.randrange(5)} บาท", lambda: f"{rng.random()} own words {rng.random()}",
    ]
    rows = [(i, "\n".join(rng.choice(shapes)() for _ in range(rng.randrange(7))), "en", "s") for i in range(60)]
    gone = cases.dropped_lines([r[:2] for r in rows], line_dedup.DEPTH, line_dedup.MIN_DOCS, line_dedup.CONSTANT, line_dedup.SHORT, line_dedup.SHORT_CONSTANT, line_dedup.SHORT_LEAST)
    found = {r.doc_id: r for r in line_dedup.dedup(cases.without_clash(spark, rows)).collect()}
    for (key, text, *_), drop in zip(rows, gone):
        assert found[key].text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) and found[key].n_dropped == len(drop)
    assert sum(map(len, gone)) > 50


# the pipeline

def stages(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        out.append((docs.columns, rows))
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages_take_effect(spark):
    docs = documents(spark)
    made = stages(spark, docs)
    language, lines, near, mix, pack = (rows for _, rows in made)
    assert all(columns == docs.columns for columns, _ in made[:-1])
    assert 0.97 * docs.count() <= len(language) <= docs.count()
    check_lines([r for r in line_dedup.dedup(spark.createDataFrame(language, docs.schema)).collect()], [(r.doc_id, r.text) for r in language])
    by = {r.doc_id: r.text for r in language}
    assert all(r.n_chars == len(r.text) for r in lines if r.text != by[r.doc_id])
    assert sum(r.text == by[r.doc_id] for r in lines) > 0.5 * len(lines)
    _, root = cases.near([r.text for r in sorted(lines, key=lambda r: r.doc_id)])
    assert sorted(r.doc_id for r in near) == sorted({r.doc_id for r, at in zip(sorted(lines, key=lambda r: r.doc_id), range(len(root))) if root[at] == at})
    assert {tuple(r) for r in mix} <= {tuple(r) for r in near}
    assert check_packed(pack, [(r.doc_id, r.text) for r in mix]) > 0.9


def test_stages_of_awkward_rows(spark):
    df = cases.table(spark)
    made = stages(spark, df)
    assert all(columns == df.columns for columns, _ in made[:-1])
    assert all(rows == [] for _, rows in stages(spark, cases.empty(spark)))


def test_run_reads_the_documents(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 200
