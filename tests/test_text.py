import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from textsignal.functions import text
from textsignal.functions.lexicon import (
    AI, AI_SUBSTRINGS, ANXIETY, ANXIETY_SUBSTRINGS, JOB, MODERATE, NEGATIONS, OPTIMISM_SUBSTRINGS, SEVERE,
    Lexicon,
)
from textsignal.operators import label


def apply(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", make(F.col("t"))).orderBy("i").collect()]


def light(t):
    return text.clean_light(F.lower(t))


def full(t):
    return text.clean_full(F.lower(t))


def test_list_sizes():
    assert [len(x.terms) for x in (AI, JOB, ANXIETY, SEVERE, MODERATE)] == [12, 22, 16, 4, 12]
    assert [len(x.terms) for x in (AI_SUBSTRINGS, ANXIETY_SUBSTRINGS, OPTIMISM_SUBSTRINGS)] == [32, 50, 32]


@pytest.mark.parametrize("lexicon", [AI, JOB, ANXIETY])
def test_every_term_holds_a_needle(lexicon):
    assert all(any(n in t for n in lexicon.needles) for t in lexicon.terms)


def test_light_clean_keeps_punctuation(spark):
    values = ["Hello,  World!\n\tSee http://a.b/c?d now", "WWWhat is www.x.y", None, "  a \t b  ", "plain text"]
    want = ["hello, world! see now", "is", None, "a b", "plain text"]
    assert apply(spark, values, light) == want


def test_full_clean(spark):
    values = ["I'm NOT   worried!", "wwwhat www.x.y z", None, "don't worry", "dont  worry", "don’t worry", "café_é ½ ²", "a b"]
    want = ["i m not_worried", "wwwhat z", "", "dont_worry", "dont_worry", "don t worry", "café_é ½ ²", "a b"]
    assert apply(spark, values, full) == want


# What the full clean gives for links, signs and white space around words, and for phrases that are merged or not.
FULL = {
    "HTTPS://a.b/?x=1 end": "end", "(www.a.b) end": "end", "www end": "www end", "a-b_c": "a b_c", "…": "", "\u3000x\x85y\x0b": "x y",
    "Not Worried": "not_worried", "not\tscared": "not_scared", "no  fear": "no_fear", "x! not worried? y": "x not_worried y",
    "DON'T worry": "dont_worry", "dont worry": "dont_worry", "not, worried": "not worried", "knot worried": "knot worried",
    "not worriedly": "not worriedly", "no fears": "no fears",
}


def test_full_clean_of_single_cases(spark):
    assert apply(spark, list(FULL), full) == list(FULL.values())


def test_every_negation_is_merged(spark):
    phrases = [p.replace("'?", "") for p, _ in NEGATIONS]
    assert apply(spark, [f"x {p.upper()}! y" for p in phrases], full) == [f"x {t} y" for _, t in NEGATIONS]


def test_adjacent_negations_are_all_merged(spark):
    assert apply(spark, ["not worried not worried"], full) == ["not_worried not_worried"]


def test_hits_count_different_words(spark):
    values = ["worried worried", "fearful", "fear", "panic, worry", None, "not_worried", "anxiety²"]
    assert apply(spark, values, lambda t: text.hits(t, ANXIETY)) == [1, 1, 1, 2, 0, 0, 0]


def test_overlapping_terms_count_each(spark):
    assert apply(spark, ["the future of work", "large language models"], lambda t: text.hits(t, JOB)) == [2, 0]
    assert apply(spark, ["doomed"], lambda t: text.hits(t, ANXIETY_SUBSTRINGS)) == [2]


def test_word_edges_are_unicode(spark):
    values = ["aiê", "ai", "said", "the ai.", "l'ai"]
    assert apply(spark, values, lambda t: text.any_hit(t, AI)) == [False, True, False, True, True]


def test_severity_and_levels(spark):
    values = ["", "worry", "panic", "panic worry", "panic hopeless", "panic hopeless fear"]
    assert apply(spark, values, lambda t: text.severity(t, label.TIERS)) == [0, 1, 2, 3, 4, 5]
    levels = apply(spark, values, lambda t: label.intensity_bucket(text.severity(t, label.TIERS)))
    assert levels == [0, 1, 2, 2, 3, 3]


def test_mask_keeps_merged_tokens(spark):
    values = ["worried fear x", "not_worried", "Panic now", None, "fearfully"]
    want = ["    x", "not_worried", "  now", "", "fearfully"]
    assert apply(spark, values, lambda t: text.mask(t, ANXIETY)) == want


def test_accents(spark):
    values = ["éàü ñ", "ﬁn ĳ", "é", "plain", "ångström ½"]
    want = [
        "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values
    ]
    assert apply(spark, values, text.strip_accents) == want


def test_accents_of_every_character(spark):
    """Equal to the decomposition without combining characters, for all characters that have a meaning here."""
    codes = [c for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(map(chr, codes[i:i + 97])) for i in range(0, len(codes), 97)]
    for got, t in zip(apply(spark, texts, text.strip_accents), texts, strict=True):
        assert got == text.without_marks(t)
    alone = [chr(c) for c in codes if text.without_marks(chr(c)) != chr(c)]
    assert len(alone) > 15_000
    assert apply(spark, alone, text.strip_accents) == [text.without_marks(c) for c in alone]


def test_accents_of_other_scripts(spark):
    values = ["हिन्दी किताब", "ภาษาไทยที่นี่", "Ελλάδα ἄνθρωπος", "Й й ё", "한국어 사람", "ｆｕｌｌ　ｗｉｄｔｈ", "עִבְרִית", "مَرْحَبًا", "𝔘nicode ﷺ", None, ""]
    assert apply(spark, values, text.strip_accents) == [None if v is None else text.without_marks(v) for v in values]
    words = apply(spark, values, text.tokens)
    assert words == [re.findall(r"\w\w+", text.without_marks((v or "").lower())) for v in values]


def test_found_terms_of_all_lists_in_one_pass(spark):
    """Equal to a test of each term by itself, for terms that overlap, nest, follow each other and stand at edges."""
    lists = [Lexicon("a", ("machine", "machine learning", "learning", "learning curve", "curve")), Lexicon("b", ("ai", "laid off", "off", "machine learning curve"))]
    words = ["machine", "learning", "curve", "ai", "laid", "off", "machines", "-", "é", "_ai", "ai."]
    rng = random.Random(3)
    values = [rng.choice([" ", "  ", ", "]).join(rng.choice(words) for _ in range(rng.randrange(7))) for _ in range(300)] + [None, "", "ai", "ai ai"]
    found = apply(spark, values, lambda t: text.found_terms(t, *lists))
    edge = r"(?<!\w){}(?!\w)"
    want = [{t for x in lists for t in x.terms if re.search(edge.format(re.escape(t)), v or "")} for v in values]
    assert [set(f) for f in found] == want and [len(f) for f in found] == [len(w) for w in want]
    for x in lists:
        assert apply(spark, values, lambda t, x=x: text.count_of(text.found_terms(t, *lists), x)) == [len(w & set(x.terms)) for w in want]
        assert apply(spark, values, lambda t, x=x: text.any_of(text.found_terms(t, *lists), x)) == [bool(w & set(x.terms)) for w in want]
    with pytest.raises(ValueError):
        text.found_terms(F.col("t"), AI, AI_SUBSTRINGS)


@pytest.mark.parametrize("lexicon", [AI, JOB, ANXIETY, AI_SUBSTRINGS, ANXIETY_SUBSTRINGS, OPTIMISM_SUBSTRINGS])
def test_hits_equal_a_test_of_each_term(spark, lexicon):
    rng = random.Random(9)
    parts = [*lexicon.terms, "x", "", "s"]
    values = ["".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(9))) for _ in range(300)]

    def holds(t, v):
        return t in v if not lexicon.whole_words else re.search(rf"(?<!\w){re.escape(t)}(?!\w)", v)

    want = [sum(bool(holds(t, v)) for t in lexicon.terms) for v in values]
    assert apply(spark, values, lambda t: text.hits(t, lexicon)) == want
    assert apply(spark, values, lambda t: text.any_hit(t, lexicon)) == [n > 0 for n in want]


def test_severity_takes_one_pass(spark):
    plan = spark.range(1).select(text.severity(F.col("id").cast("string"), label.TIERS).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1 and "rlike" not in plan.lower()


def test_tokens_and_bigrams(spark):
    found = apply(spark, ["I've a BIG café", "one", ""], lambda t: text.tokens(t))
    assert found == [["ve", "big", "cafe"], ["one"], []]
    both = apply(spark, ["the big red car", "the", ""], lambda t: text.with_bigrams(text.drop_words(text.tokens(t), ["the"])))
    assert both == [["big", "red", "car", "big red", "red car"], [], []]
