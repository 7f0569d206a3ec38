"""Ids of a byte-level BPE tokenizer, with its merges run once for each distinct pre-token."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from textsignal.llm.common import running, spans

GATHER = 1 << 19  # characters whose pre-tokens are found together
RECENT = 100_000  # distinct pre-tokens that are kept apart until they join the others
REMEMBERED = 1_500_000  # distinct pre-tokens whose ids a worker keeps, some 40 bytes each
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SIMPLE, _DOUBLE = "stmd", ("re", "ve", "ll")  # Fixed values: the endings after an apostrophe that are pre-tokens
_state: dict[str, object] = {}


def _kinds() -> np.ndarray:
    """By code point: 0 white space, 1 other, 2 number, 3 letter, 4 not assigned (tables may differ there)."""
    if "kinds" not in _state:
        kinds = np.full(0x10000, 1, np.uint8)
        for code in range(0x10000):
            category = unicodedata.category(chr(code))
            kinds[code] = {"L": 3, "N": 2}.get(category[0], 4 if category in ("Cn", "Cs") else 1)
        kinds[list(_SPACES)] = 0
        _state["kinds"] = kinds
    return _state["kinds"]


def tokenizer(path: str):
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core
        from tokenizers import Tokenizer

        _state[path] = Tokenizer.from_file(path)
    return _state[path]


def merger(path: str):
    """The merges of the tokenizer's vocabulary, for one pre-token at a time.

    The file prints each byte as a character: itself where it can be seen, else the next one from 256.
    """
    key = f"merges of {path}"
    if key not in _state:
        import tiktoken

        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(byte[c] for c in piece): i for piece, i in vocabulary.items() if all(c in byte for c in piece)}
        ranks.pop(b"<|endoftext|>", None)
        _state[key] = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return _state[key]


def pre_tokens(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: runs of letters, of numbers, of other signs, with one blank before, and white space.

    Of white space before a run the last character is left out: a blank belongs to the run, another
    sign stands alone. An apostrophe that begins its run and the endings 's 't 'm 'd 're 've 'll go together.
    """
    n, kind = len(codes), _kinds()[codes]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[at[:-1][at[:-1] < n]] = True
    edge = np.zeros(n + 3, bool)  # a text begins here, or all texts have ended
    edge[at] = True
    edge[n:] = True
    last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~edge[1:n]) if n else np.zeros(0, np.int64)
    begin[last] = True
    begin[last[codes[last] == 0x20] + 1] = False
    quote = np.flatnonzero((codes == 0x27) & begin)
    quote = quote[~edge[quote + 1]]
    quote = quote[kind[quote + 1] == 3]
    one = quote[np.isin(codes[quote + 1], [ord(c) for c in _SIMPLE])]
    two = quote[~edge[quote + 2]]
    two = two[np.isin(codes[two + 1].astype(np.int64) << 32 | codes[two + 2], [ord(a) << 32 | ord(b) for a, b in _DOUBLE])]
    for found, size in ((one, 1), (two, 2)):
        begin[found + 1] = False
        rest = found + 1 + size
        rest = rest[~edge[rest]]
        begin[rest[kind[rest] == 3]] = True
    return np.flatnonzero(begin)


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, without special tokens: what the tokenizer itself gives for the whole text.

    A text that holds the string of an added token, or characters that the pre-tokens' tables don't
    cover, goes through the tokenizer as it is.
    """
    own = tokenizer(path)
    added = [t.content for t in own.get_added_tokens_decoder().values()]
    out: list[np.ndarray | None] = [None] * len(texts)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    plain, size = [], 0

    def flush():
        nonlocal size
        if plain:
            for i, ids in zip(plain, _together([texts[i] for i in plain], [codes[i] for i in plain], own, path)):
                out[i] = ids
        plain.clear()
        size = 0

    for i, text in enumerate(texts):
        if any(a in text for a in added) or (len(text) and (codes[i].max() > 0xFFFF or (_kinds()[codes[i]] == 4).any())):
            out[i] = np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
            continue
        plain.append(i)
        size += len(text)
        if size >= GATHER:
            flush()
    flush()
    return out


class _Known:
    """Ids of the pre-tokens met so far: sorted hashes, each with its number, and the ids by number.

    New ones go to a small second table first, which is cheap to extend.
    """

    def __init__(self):
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.length, self.begin, self.ids = (np.zeros(0, k) for k in (np.int64, np.int64, np.uint32))

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each hash, and whether it is known."""
        number, there = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        open_ = np.arange(len(h))
        for hashes, numbers in self.tables:
            if len(hashes) and len(open_):
                at = np.minimum(np.searchsorted(hashes, h[open_]), len(hashes) - 1)
                hit = hashes[at] == h[open_]
                number[open_[hit]], there[open_[hit]] = numbers[at[hit]], True
                open_ = open_[~hit]
        return number, there

    def add(self, h: np.ndarray, made: list[list[int]]) -> None:
        """New pre-tokens; their hashes are sorted."""
        length = np.array([len(m) for m in made], np.int64)
        number = len(self.length) + np.arange(len(h))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.array([y for m in made for y in m], np.uint32)])
        main, recent = self.tables
        recent = _merged(recent, (h, number))
        if len(recent[0]) > RECENT:
            main, recent = _merged(main, recent), (recent[0][:0], recent[1][:0])
        self.tables = [main, recent]

    def __len__(self) -> int:
        return len(self.length)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


def _together(texts: list[str], codes: list[np.ndarray], own, path: str) -> list[np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    data, whole = np.concatenate(codes), "".join(texts)
    start = pre_tokens(data, at)
    end = np.append(start[1:], len(data))[:len(start)]
    h = spans(running(data), start, end)
    known = _state.setdefault(f"ids of {path}", _Known())
    if len(known) > REMEMBERED:
        known = _state[f"ids of {path}"] = _Known()
    place, there = known.place(h)
    missing = np.flatnonzero(~there)
    if len(missing):
        new, first = np.unique(h[missing], return_index=True)
        merges = merger(path)
        known.add(new, [
            merges.encode_ordinary(whole[a:b])
            for a, b in zip(start[missing[first]].tolist(), end[missing[first]].tolist())
        ])
        place[missing] = known.place(h[missing])[0]
    sizes = known.length[place]
    places = np.cumsum(sizes) - sizes
    index = np.repeat(known.begin[place] - places, sizes) + np.arange(int(sizes.sum()))
    edges = np.append(places, int(sizes.sum()))[np.searchsorted(start, at)]
    return np.split(known.ids[index], edges[1:-1])
