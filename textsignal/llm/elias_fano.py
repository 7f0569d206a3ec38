"""Elias-Fano sequences, and an n-gram trie made of them in one memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

STEPS = 65535  # of a quantised value
FLOOR = -16.0  # log10 of the smallest value
SLICE = 1 << 16  # lookups done together
STEP = 4  # a directory has an entry for each 2**STEP ones, or zeros


def quantise(values: np.ndarray) -> np.ndarray:
    """Logarithms between ``FLOOR`` and 0 in 16 bits."""
    return np.rint(np.clip(values / FLOOR, 0, 1) * STEPS).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (FLOOR / STEPS)


class EliasFano:
    """A sorted sequence of integers in about 2 + log2(universe / n) bits each.

    The low bits stand side by side; the high bits are a bitmap with a one for each element,
    after as many zeros as its high part says. Sums by word, and the word of each 16th, find any one or zero quickly.
    """

    def __init__(self, values: np.ndarray, universe: int):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        self.low = max(0, (int(universe) // max(1, self.n)).bit_length() - 1)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        bits = self.n + (int(universe) >> self.low) + 2
        marks = np.zeros(-(-bits // 64) * 64, bool)
        marks[high + np.arange(self.n)] = True
        self.words = np.packbits(marks, bitorder="little").view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.zeros = np.arange(len(self.words) + 1) * 64 - self.ones
        self.nth_one, self.nth_zero = self._directory(self.ones), self._directory(self.zeros)
        self.lows = self._packed(values)

    @staticmethod
    def _directory(sums: np.ndarray) -> np.ndarray:
        """The word of each 2**STEP-th one or zero, and the last word."""
        places = np.arange(0, int(sums[-1]), 1 << STEP)
        return np.append(np.searchsorted(sums, places, "right") - 1, max(len(sums) - 2, 0)).astype(np.int32)

    @staticmethod
    def _word(sums: np.ndarray, directory: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The word that holds the one or zero of rank k: between two entries of the directory."""
        at = k >> STEP
        word, last = directory[at], directory[at + 1]
        open_ = np.flatnonzero(word < last)
        low, high, wanted = word[open_], last[open_], k[open_]
        while len(open_):
            middle = (low + high + 1) >> 1
            here = sums[middle] <= wanted
            low, high = np.where(here, middle, low), np.where(here, high, middle - 1)
            word[open_] = low
            more = low < high
            open_, low, high, wanted = open_[more], low[more], high[more], wanted[more]
        return word.astype(np.int64)

    def _packed(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n * self.low // 64 + 2, np.uint64)
        for i in range(0, self.n if self.low else 0, SLICE):  # whole words: a slice begins where one does
            part = values[i:i + SLICE] & np.uint64((1 << self.low) - 1)
            at = np.arange(i, i + len(part), dtype=np.int64) * self.low
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.concatenate([[True], word[1:] != word[:-1]])
            begin = np.flatnonzero(first)
            out[word[begin]] |= np.bitwise_or.reduceat(part << shift, begin)
            over = np.flatnonzero(shift.astype(np.int64) + self.low > 64)
            np.bitwise_or.at(out, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in ("words", "zeros", "ones", "nth_zero", "nth_one", "lows")}

    def __len__(self) -> int:
        return self.n

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.lows[word] >> shift
        value |= np.where(shift > 0, self.lows[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return value & np.uint64((1 << self.low) - 1)

    @staticmethod
    def _inside(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the one of a given rank in each word."""
        place = np.zeros(len(word), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((word >> place) & np.uint64((1 << width) - 1)).astype(np.int64)
            on = rank >= part
            rank = rank - part * on
            place += np.uint64(width) * on.astype(np.uint64)
        return place.astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero of rank k in the bitmap."""
        word = self._word(self.zeros, self.nth_zero, k)
        return word * 64 + self._inside(~self.words[word], k - self.zeros[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The elements of the given ranks."""
        i = np.asarray(i, np.int64)
        word = self._word(self.ones, self.nth_one, i)
        place = word * 64 + self._inside(self.words[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def values(self) -> np.ndarray:
        """All elements in order: the places of the ones, read in one go."""
        ranks = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[:self.n] - ranks
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(ranks)

    def successor(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the first element >= x among the ranks from ``low`` to before ``high``, and whether it is x.

        The zeros around x's high part bound the elements that share it; their low bits are searched.
        """
        if not len(x) or not self.n:
            return low, np.zeros(len(x), bool)
        part = (x >> np.uint64(self.low)).astype(np.int64)
        part = np.minimum(part, int(self.zeros[-1]) - 1)
        begin = np.where(part > 0, self._zero(np.maximum(part - 1, 0)) - np.maximum(part - 1, 0), 0)
        end = self._zero(part) - part
        begin, end = np.clip(begin, low, high), np.clip(end, low, high)
        wanted, stop = x & np.uint64((1 << self.low) - 1), end.copy()
        while True:
            open_ = np.flatnonzero(begin < stop)
            if not len(open_):
                break
            middle = (begin[open_] + stop[open_]) >> 1
            less = self._low(middle) < wanted[open_]
            begin[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
        found = begin < end
        hit = np.flatnonzero(found)
        found[hit] = self._low(begin[hit]) == wanted[hit]
        return begin, found


def _monotone(values: np.ndarray, pointers: np.ndarray) -> tuple[EliasFano, int]:
    """Ranges that are sorted each for itself, made one sorted sequence: each range starts from the last value before it."""
    last = np.zeros(len(pointers) - 1, np.uint64)
    filled = pointers[1:] > pointers[:-1]
    last[filled] = values[pointers[1:][filled] - 1].astype(np.uint64)
    base = np.concatenate([[np.uint64(0)], np.cumsum(last)[:-1]]) if len(last) else last
    whole = values.astype(np.uint64) + np.repeat(base, np.diff(pointers))
    return EliasFano(whole, int(whole[-1]) + 1 if len(whole) else 1), len(whole)


class Trie:
    """Words, bigrams and trigrams with quantised log10 probabilities and back-off weights.

    Level 1 is the sorted word hashes. Levels 2 and 3 hold, behind monotone pointers, the successors of
    each n-gram above. A word of level 3 is stored as its rank among the successors of the word
    before it. All arrays lie in one memory-mapped file without a name, which goes with the trie.
    """

    def __init__(self, words: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray],
                 prob: list[np.ndarray], back: list[np.ndarray]):
        """``words``: sorted hashes. ``pairs``: sorted numbers of words. ``triples``: sorted numbers of their first pair and of their second."""
        n, m = len(words), len(pairs[0])
        self.words = EliasFano(words, 1 << 64)
        first = np.searchsorted(pairs[0], np.arange(n + 1))
        self.first = EliasFano(first, m + 1)
        self.pairs, _ = _monotone(pairs[1], first)
        second = np.searchsorted(triples[0], np.arange(m + 1))
        self.second = EliasFano(second, len(triples[0]) + 1)
        below = triples[1]
        self.triples, _ = _monotone(below - first[pairs[0][below]] if len(below) else below, second)
        # codes are taken as they are
        self.prob, self.back = ([v if v.dtype == np.uint16 else quantise(v) for v in level] for level in (prob, back))
        self._map()

    def _map(self) -> None:
        parts = [(o, k, a) for o in (self.words, self.first, self.pairs, self.second, self.triples) for k, a in o.arrays().items()]
        parts += [(c, i, a) for c in (self.prob, self.back) for i, a in enumerate(c)]
        self._file = tempfile.TemporaryFile()
        at = []
        for _, _, a in parts:
            at.append(self._file.tell())
            self._file.write(np.ascontiguousarray(a).tobytes())
            self._file.write(b"\0" * (-self._file.tell() % 64))
        self._file.flush()
        for (owner, key, a), offset in zip(parts, at):
            # a plain view of the mapped file: cheaper to index than its own class
            view = np.memmap(self._file, a.dtype, "r", offset, a.shape).view(np.ndarray) if a.size else a
            if isinstance(owner, list):
                owner[key] = view
            else:
                setattr(owner, key, view)

    @staticmethod
    def _ranges(pointers: EliasFano, level: EliasFano) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of each context begin and end in the level, and the value that each range starts from."""
        ends = pointers.values().astype(np.int64)
        base = np.zeros(len(ends) - 1, np.uint64)
        inner = np.flatnonzero((ends[:-1] > 0) & (ends[:-1] < ends[1:]))
        for i in range(0, len(inner), SLICE):
            base[inner[i:i + SLICE]] = level.access(ends[inner[i:i + SLICE]] - 1)
        return ends, base

    @staticmethod
    def _find(ranges: tuple[np.ndarray, np.ndarray], level: EliasFano, context: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank in the level of a value among the successors of its context, and whether it is there; some at a time."""
        ends, base = ranges
        at, found = np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        for i in range(0, len(context), SLICE):
            part = slice(i, i + SLICE)
            of = context[part]
            at[part], found[part] = level.successor(value[part] + base[of], ends[of], ends[of + 1])
        return at, found

    def word(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if unknown."""
        if len(hashes) > SLICE:
            return np.concatenate([self.word(hashes[i:i + SLICE]) for i in range(0, len(hashes), SLICE)])
        at, found = self.words.successor(hashes, np.zeros(len(hashes), np.int64), np.full(len(hashes), len(self.words)))
        return np.where(found, at, -1)

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each pair of word numbers, -1 if there is none."""
        out = np.full(len(first), -1)
        known = np.flatnonzero((first >= 0) & (second >= 0))
        at, found = self._find(self._ranges(self.first, self.pairs), self.pairs, first[known], second[known].astype(np.uint64))
        out[known[found]] = at[found]
        return out

    def triple(self, pair: np.ndarray, middle: np.ndarray, next_pair: np.ndarray) -> np.ndarray:
        """Number of each trigram, from the number of its first pair, its middle word and its second pair."""
        out = np.full(len(pair), -1)
        known = np.flatnonzero((pair >= 0) & (next_pair >= 0))
        relative = next_pair[known] - self.first.values().astype(np.int64)[middle[known]]
        at, found = self._find(self._ranges(self.second, self.triples), self.triples, pair[known], relative.astype(np.uint64))
        out[known[found]] = at[found]
        return out
