"""Text functions: each takes and returns a Column, with built-in functions only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsignal.functions.lexicon import NEGATIONS, SPACE, WORD, Lexicon, whole_word

_LIGHT_URL = r"http\S+|www\S+"
_FULL_URL = rf"(?:http|www\.)[^\s\x0B\x1C-\x1F\x85\p{{Z}}]+"
# Only runs that differ from one blank need replacing.
_LOOSE_SPACE = r"[\t\n\x0B\f\r]\s*| \s+"
_NON_WORDS = r"[^\p{L}\p{N}_]+"
TOKEN = WORD + "{2,}"
_ASCII_TOKEN = r"\w{2,}"  # the same in ASCII text, without a look at each character's category
_PLAIN = re.compile(r"[A-Za-z0-9_]+")


def _contains_any(col: Column, needles: Sequence[str]) -> Column:
    return reduce(Column.__or__, [col.contains(n) for n in needles])


def _without_links(col: Column, pattern: str) -> Column:
    """Links to blanks; the regular expression runs only on text that has a link."""
    return F.when(
        _contains_any(col, ("http", "www")), F.regexp_replace(col, pattern, " ")
    ).otherwise(col)


def clean_light(lower: Column) -> Column:
    """Links in lower-case text to blanks, white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(_without_links(lower, _LIGHT_URL), _LOOSE_SPACE, " "))


def merge_negations(col: Column, negations: Sequence[tuple[str, str]] = NEGATIONS) -> Column:
    """Turn each negated phrase into one token, in list order.

    One test for all phrases comes first: most texts hold none.
    """
    phrases = [(phrase.replace(" ", SPACE + "+"), token) for phrase, token in negations]
    merged = reduce(
        lambda c, pair: F.regexp_replace(c, whole_word(pair[0], pair[0][0]), pair[1]), phrases, col
    )
    initials = "".join(sorted({p[0] for p, _ in phrases}))
    some = col.rlike(whole_word("|".join(p for p, _ in phrases), initials))
    return F.when(some, merged).otherwise(col)


def clean_full(lower: Column, negations: Sequence[tuple[str, str]] = NEGATIONS) -> Column:
    """Links out of lower-case text, negations merged, every non-word run to one blank; null gives empty text."""
    merged = merge_negations(_without_links(F.coalesce(lower, F.lit("")), _FULL_URL), negations)
    return F.trim(F.regexp_replace(merged, _NON_WORDS, " "))


def any_hit(col: Column, lexicon: Lexicon) -> Column:
    """True when at least one term occurs; ``col`` must be lower case.

    Plain substring tests rule most texts out before the regular expression runs.
    """
    return may_hit(col, lexicon) & col.rlike(lexicon.regex)


def may_hit(col: Column, lexicon: Lexicon) -> Column:
    """False for most texts without a term, by plain substring tests alone."""
    return _contains_any(col, _needles(lexicon))


def _needles(lexicon: Lexicon) -> Sequence[str]:
    """Substrings of which any text with a term holds at least one."""
    return lexicon.needles or [t for t in lexicon.terms if not any(o != t and o in t for o in lexicon.terms)]


def _once(col: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once a row, however often the result names it."""
    return F.get(F.transform(F.array(col), make), 0)


def found_terms(col: Column, *lexicons: Lexicon) -> Column:
    """All different terms of the lists that occur in lower-case ``col``; null has none.

    Substrings are plain tests, one for each term. The text's words are taken out in one pass and meet the terms that are one
    plain word; any other term has a plain test and, where that holds, an expression of its own. The text and its words are
    computed once a row: named in each branch, they would be computed again with each.
    """
    every = Lexicon("+".join(x.name for x in lexicons), tuple(dict.fromkeys(t for x in lexicons for t in x.terms)), lexicons[0].whole_words)
    if any(x.whole_words != every.whole_words for x in lexicons):
        raise ValueError("lists of whole words and of substrings can't share a pass")
    text = F.coalesce(col, F.lit(""))
    if not every.whole_words:
        return _once(text, lambda t: F.filter(F.array(*map(F.lit, every.terms)), lambda term: F.contains(t, term)))
    plain = [t for t in every.terms if _PLAIN.fullmatch(t)]
    others = [t for t in every.terms if not _PLAIN.fullmatch(t)]

    def found(t: Column) -> Column:
        parts = []
        if plain:
            parts.append(F.array_intersect(F.array(*map(F.lit, plain)), _words(t)))
        if others:
            tests = [F.when(F.contains(t, F.lit(o)) & t.rlike(every.pattern(o)), F.lit(o)) for o in others]
            parts.append(F.filter(F.array(*tests), lambda o: o.isNotNull()))
        return F.concat(*parts)

    return _once(text, lambda t: F.when(may_hit(t, every), found(t)).otherwise(F.array().cast("array<string>")))


def count_of(found: Column, lexicon: Lexicon) -> Column:
    """How many terms of a list are among the found ones."""
    return F.size(F.array_intersect(found, F.array(*map(F.lit, lexicon.terms))))


def any_of(found: Column, lexicon: Lexicon) -> Column:
    """Whether a term of a list is among the found ones."""
    return F.arrays_overlap(found, F.array(*map(F.lit, lexicon.terms)))


def hits(col: Column, lexicon: Lexicon) -> Column:
    """Number of different terms that occur in lower-case ``col``; null counts 0."""
    return F.size(found_terms(col, lexicon))


def severity(col: Column, tiers: Sequence[tuple[Lexicon, int]]) -> Column:
    """Weighted number of different terms that occur in lower-case ``col``; one pass finds those of all tiers."""
    weighed = [(F.array(*map(F.lit, lexicon.terms)), weight) for lexicon, weight in tiers]
    return F.aggregate(
        found_terms(col, *[lexicon for lexicon, _ in tiers]), F.lit(0),
        lambda total, term: total + sum((F.when(F.array_contains(terms, term), weight).otherwise(0) for terms, weight in weighed), F.lit(0)),
    )


def mask(col: Column, lexicon: Lexicon) -> Column:
    """Blank out every term of the lexicon; null becomes empty text."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), "(?i)" + lexicon.regex, " ")


def whole_number(name: str) -> Column:
    """The column's number, or its text read as one, as int, also with a decimal point; null where it is none."""
    return F.expr(f"try_cast(try_cast({name} AS double) AS int)")


def text_length(col: Column) -> Column:
    return F.length(F.coalesce(col, F.lit("")))


def without_marks(text: str) -> str:
    """Unicode's compatibility decomposition without the characters that combine with others."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _combining() -> str:
    """A class of the characters whose combining class isn't 0, as ranges.

    They are marks, or unknown to the JVM, which is one lookup a character; the hundreds of ranges are tried on those alone.
    """
    ends: list[list[int]] = []
    for code in range(0x300, 0x20000):
        if unicodedata.combining(chr(code)):
            if ends and ends[-1][1] == code - 1:
                ends[-1][1] = code
            else:
                ends.append([code, code])
    return r"[[\p{M}\p{Cn}]&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ends) + "]]+"


_COMBINING = _combining()


def _is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def _words(col: Column) -> Column:
    """All runs of word characters, in text order."""
    return F.regexp_extract_all(col, F.when(_is_ascii(col), r"\w+").otherwise(WORD + "+"), F.lit(0))


def _decomposed(col: Column) -> Column:
    """The compatibility decomposition, by the Unicode library that Spark's collations use."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(col, F.lit("")), F.lit(True))


def strip_accents(col: Column) -> Column:
    """Text without accents, in any script: decomposed, and without what combines; null stays null.

    Vowel signs that do not combine stay, as they are, and ligatures are spelt out. ASCII text is passed through.
    """
    def plain(t: Column) -> Column:
        return F.when(_is_ascii(t), t).when(t.isNotNull(), F.regexp_replace(_decomposed(t), _COMBINING, ""))

    return _once(col, plain)


def tokens(col: Column) -> Column:
    """Words of two or more characters, accents stripped, in text order."""
    def found(t: Column) -> Column:
        ascii_words, words = (F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (_ASCII_TOKEN, TOKEN))
        return F.when(_is_ascii(t), ascii_words).otherwise(words)

    return _once(strip_accents(F.lower(F.coalesce(col, F.lit("")))), found)


def drop_words(words: Column, stop_words: Sequence[str]) -> Column:
    """Words without the stop words, repeats and order kept."""
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def with_bigrams(words: Column) -> Column:
    """The words, none of them null, followed by every pair of neighbours."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)
