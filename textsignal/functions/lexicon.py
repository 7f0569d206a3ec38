"""Word lists and the regular expressions compiled from them.

Edges are written as look-arounds over letters, digits and underscore. They do
not consume the separator, so two adjacent words are both found, and the result
does not depend on how a JDK version reads ``\\b``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _escape(term: str) -> str:
    return re.sub(r"([^\w\s'])", r"\\\1", term)


def whole_word(body: str, initials: str = "") -> str:
    """``body`` between word edges; ``initials``, where known, skip other positions early."""
    start = f"(?=[{initials}])" if initials else ""
    return rf"{start}(?<!{WORD})(?:{body})(?!{WORD})"


@dataclass(frozen=True)
class Lexicon:
    """A named list of lower-case terms, matched as whole words or as substrings."""

    name: str
    terms: tuple[str, ...]
    whole_words: bool = True

    def pattern(self, term: str) -> str:
        return whole_word(_escape(term), _escape(term[0])) if self.whole_words else _escape(term)

    @property
    def regex(self) -> str:
        body = "|".join(_escape(t) for t in self.terms)
        initials = "".join(sorted({t[0] for t in self.terms}))
        return whole_word(body, initials) if self.whole_words else body

    @property
    def needles(self) -> tuple[str, ...]:
        """Substrings of which any text with a term holds at least one."""
        if not self.whole_words:
            return ()
        longest = {max(t.split(" "), key=len) for t in self.terms}
        return tuple(sorted(n for n in longest if not any(o != n and o in n for o in longest)))


# Theme and signal word lists, whole-word matching.
AI = Lexicon("ai", (
    "ai", "artificial intelligence", "chatgpt", "gpt", "llm", "llms",
    "large language model", "large language models", "generative ai",
    "automation", "automate", "machine learning",
))
JOB = Lexicon("job", (
    "job", "jobs", "career", "careers", "work", "worker", "workers",
    "employment", "unemployment", "unemployed", "layoff", "layoffs", "laid off",
    "replace", "replaced", "replacing", "hiring", "profession", "professional",
    "reskill", "upskill", "future of work",
))
ANXIETY = Lexicon("anxiety", (
    "anxiety", "anxious", "worried", "worry", "scared", "fear", "fearful",
    "stress", "stressed", "panic", "overwhelmed", "uncertain", "uncertainty",
    "terrified", "afraid", "hopeless",
))
SEVERE = Lexicon("severe", ("panic", "overwhelmed", "terrified", "hopeless"))
MODERATE = Lexicon("moderate", tuple(t for t in ANXIETY.terms if t not in SEVERE.terms))

# Negated phrases and their merged tokens. A blank stands for any
# run of white space.
NEGATIONS = (
    ("not worried", "not_worried"),
    ("not scared", "not_scared"),
    ("not afraid", "not_afraid"),
    ("don'?t worry", "dont_worry"),
    ("no fear", "no_fear"),
    ("not stressed", "not_stressed"),
    ("not anxious", "not_anxious"),
    ("not concerned", "not_concerned"),
)

# Community types.
COMMUNITIES = {
    "career": ("jobs", "careerguidance", "unemployment"),
    "ai": ("machinelearning", "openai", "datascience"),
    "mental_health": ("mentalhealth", "anxiety", "depression"),
}

INTENSITY_NAMES = ("none", "low", "medium", "high")

# The alternative lists, plain substrings.
AI_SUBSTRINGS = Lexicon("ai_substrings", (
    "chatgpt", "gpt-4", "gpt4", "gpt", "openai", "llm", "llms",
    "large language model", "artificial intelligence", " ai ", "a.i.",
    "machine learning", "automation", "automate", "automated", "generative ai",
    "bard", "gemini", "claude", "copilot", "ai tool", "ai replace", "ai job",
    "robot", "algorithm", "deep learning", "neural network", "midjourney",
    "stable diffusion", "ai model", "language model", "ai system",
), whole_words=False)
ANXIETY_SUBSTRINGS = Lexicon("anxiety_substrings", (
    "worried", "worry", "scared", "terrified", "anxious", "anxiety", "fear",
    "afraid", "panic", "stressed", "stress", "losing my job", "lose my job",
    "lost my job", "job loss", "replaced by ai", "replace workers",
    "replace humans", "laid off", "layoff", "lay off", "getting fired",
    "got fired", "unemployment", "unemployed", "no job", "can't find work",
    "can't find a job", "struggling to find", "hopeless", "desperate", "doom",
    "doomed", "obsolete", "useless", "worthless", "no future",
    "what's the point", "give up", "can't compete", "depressing", "terrifying",
    "nightmare", "will i lose", "is my job safe", "am i going to lose",
    "should i be worried", "took my job", "taking jobs", "take our jobs",
), whole_words=False)
OPTIMISM_SUBSTRINGS = Lexicon("optimism_substrings", (
    "excited", "exciting", "opportunity", "opportunities", "reskill", "upskill",
    "adapt", "adapting", "growing", "growth", "promising", "optimistic",
    "hopeful", "future is bright", "new skills", "new opportunities",
    "can help", "will help", "productivity", "efficient", "augment",
    "collaborate", "partnership", "empower", "embrace", "looking forward",
    "positive", "benefit", "advantage", "create jobs", "new roles", "evolve",
), whole_words=False)
# Spark's English stop words, in its order.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've",
    "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
)
