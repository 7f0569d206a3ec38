"""Small tables of awkward rows, and brute-force versions of what the operators compute."""

import re
import zlib
from collections import Counter, defaultdict

import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These tables have a few rows; the jobs are many."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)


LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore "
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today and again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today and again", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "  \n\t \n", "de", "b"),
    (6, "12345 -- 67 !!", "de", "b"),
    (7, "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn", "de", "b"),
    (8, "one two", "en", "a"),
    (9, "one two", "en", "c"),
    (10, LONG * 60, "la", "c"),
    (11, "x" + LONG * 3 + "y", "la", "c"),
    (None, "a row without an id but with some words in it to be counted and scored here", "en", "a"),
    (12, "a row without an id but with some words in it to be counted and scored here", None, "a"),
    (13, "naïve café 😀 — 　wide\x00nul\x85 don't we'll THE END\r\nof lines\r\n", "fr", "b"),
    (13, "naïve café 😀 — 　wide\x00nul\x85 don't we'll THE END\r\nof lines\r\n", "fr", "b"),
    (14, "a" * 3000, "xx", "a"),
]


def table(spark, rows=ROWS):
    """The rows with columns that clash with those the operators make or differ from others by case alone."""
    extra = [(*r, len(r[1] or ""), i, "x", -i, "y", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, copy int, key string, batch long, TEXT string, rank int"
    ).repartition(3)


def without_clash(spark, rows=ROWS):
    """The table without its second text column, which ``drop`` would take with the first."""
    df = table(spark, rows)
    return df.toDF(*["other" if c == "TEXT" else c for c in df.columns])


def empty(spark):
    return table(spark).limit(0)


def in_fold(key, of):
    return zlib.crc32(("" if key is None else str(key)).encode()) % of


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(texts, up=4, down=5):
    """Links of every text, and the smallest place that links lead to, from all pairs."""
    sets = [shingles(t) for t in texts]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * (up + down) >= up * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(sets))]


def repeated(texts, length):
    """For each text in order: whether each byte is covered by a string that starts earlier."""
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            window = b[s:s + length]
            if window in seen:
                gone[s:s + length] = [True] * length
            seen.add(window)
        out.append(gone)
    return out


def line_tokens(line):
    """Tokens by definition: between white space; with a character of a script without blanks, each such character, runs of digits, other runs."""
    def kind(c):
        code = ord(c)
        apart = any(a <= code <= b for a, b in (
            (0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
        return "apart" if apart else "digit" if re.match(r"\d", c) else "other"

    out = []
    for token in line.split():
        kinds = [kind(c) for c in token]
        if "apart" not in kinds:
            out.append(token)
            continue
        for c, k, before in zip(token, kinds, [None, *kinds]):
            if k == before and k != "apart":
                out[-1] += c
            else:
                out.append(c)
    return out


def dropped_lines(docs, depth, least_docs, share, short, short_share, short_least):
    """Lines to drop of each document under all rules: recurring templates, short ones with fields, equal lines with digits."""
    def masked(line):
        return tuple("<*>" if re.search(r"\d", t) else t for t in line_tokens(line))

    leaf, whole, equal, met = defaultdict(set), defaultdict(set), defaultdict(set), []
    for i, (_, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            w = masked(line)
            if w:
                a = (len(w), *w[:depth])
                leaf[a].add(i)
                whole[a, w].add(i)
                met.append((i, n, a, w))
                if re.search(r"\d", line):
                    equal[tuple(line.split())].add(i)
    count = Counter()
    for (a, w), where in whole.items():
        count.update({(a, p, t): len(where) for p, t in enumerate(w)})
    where, facts, named = defaultdict(set), {}, {}
    for i, n, a, w in met:
        if len(leaf[a]) < least_docs:
            continue
        kept = [t != "<*>" and count[a, p, t] >= least_docs for p, t in enumerate(w)]
        template = a, tuple(t if k else "<*>" for t, k in zip(w, kept))
        strict = all(k or t == "<*>" for t, k in zip(w, kept))
        unspaced = any(len(t) == 1 and len(line_tokens("ab" + t)) == 2 for t in w)
        old = facts.get(template, (True, False))
        facts[template] = (old[0] and strict, old[1] or unspaced)
        where[template].add(i)
        named[i, n] = template
    out = [set() for _ in docs]
    first = lambda holders: min(holders, key=lambda j: docs[j][0])
    for (i, n), template in named.items():
        (strict, unspaced), size = facts[template], len(template[1])
        constant = sum(t != "<*>" for t in template[1])
        sure = constant >= share * size and (strict or not unspaced)
        sure |= strict and size <= short and constant >= short_share * size and constant >= short_least
        if sure and len(where[template]) >= least_docs and i != first(where[template]):
            out[i].add(n)
    for i, n, _, _ in met:
        holders = equal.get(tuple(docs[i][1].split("\n")[n].split()), ())
        if len(holders) >= least_docs and i != first(holders):
            out[i].add(n)
    return out


def recurring(docs, depth, least_tokens, least_docs, share):
    """Lines to drop of each document: pairs of key and text in, a set of line numbers for each out."""
    def masked(line):
        return tuple("<*>" if re.search(r"\d", t) else t for t in line.split())

    leaf, whole, met = defaultdict(set), defaultdict(set), []
    for i, (_, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            w = masked(line)
            if len(w) >= least_tokens:
                a = (len(w), *w[:depth])
                leaf[a].add(i)
                whole[a, w].add(i)
                met.append((i, n, a, w))
    count = Counter()
    for (a, w), where in whole.items():
        if len(leaf[a]) >= least_docs:
            count.update({(a, p, t): len(where) for p, t in enumerate(w)})
    where, named = defaultdict(set), {}
    for i, n, a, w in met:
        if len(leaf[a]) >= least_docs:
            t = a, tuple(t if t != "<*>" and count[a, p, t] >= least_docs else "<*>" for p, t in enumerate(w))
            named[i, n] = t
            where[t].add(i)
    out = [set() for _ in docs]
    for (i, n), t in named.items():
        first = min(where[t], key=lambda j: docs[j][0])
        if len(where[t]) >= least_docs and sum(x != "<*>" for x in t[1]) >= share * len(t[1]) and i != first:
            out[i].add(n)
    return out
