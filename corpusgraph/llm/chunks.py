"""Cutting texts where byte-level tokenizers may be cut, and dictionaries of the pieces.

The split pattern of these tokenizers gives a single space to the word behind it and
never spans from a non-space to a space. So a text may be cut in front of every space that
a non-space follows: each piece encodes alone as it does inside the text. Pieces
and the words in them repeat, so each is looked at once per dictionary.
"""

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusgraph.llm import wordhash

#: A space before another white space: such texts are cut by ``_CUT`` instead of at every space.
_RUN = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_CUT = re.compile(r"(?= \S)")
#: Pieces whose words are listed at once.
SPLIT_AT_ONCE = 20_000


class _Numbers(dict):
    """Numbers of strings; new ones go to ``seen``."""

    def __init__(self, seen: list):
        super().__init__()
        self.seen = seen

    def of(self, strings: list[str]) -> np.ndarray:
        new = [x for x in dict.fromkeys(strings) if x not in self]
        self.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
        self.seen.extend(new)
        return np.fromiter(map(self.__getitem__, strings), np.int32, len(strings))


def ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``begin[k] .. begin[k] + counts[k] - 1`` for every k, one after another."""
    ends = np.cumsum(counts)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1])


def gather(numbers: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values[starts[k]:starts[k + 1]]`` for every k in ``numbers``, one after another."""
    begin = starts[numbers]
    return values[ranges(begin, starts[numbers + 1] - begin)]


class PieceTable:
    """The pieces of texts by number. Pieces are known by 128 bits of hash, in sorted arrays."""

    def __init__(self):
        self._fresh, self._total = [], 0
        self._first, self._second, self._number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self):
        return self._total

    def fresh(self) -> list[str]:
        """The pieces that were numbered since the last call, in order."""
        new = self._fresh[:]
        self._fresh.clear()
        return new

    def _of(self, strings: pa.Array, prefix: str = "") -> np.ndarray:
        """Numbers of strings with ``prefix`` before them, as often as they occur."""
        coded = strings.dictionary_encode()
        strings = coded.dictionary
        raw, ends = wordhash.text_bytes(strings)
        first = wordhash.span_hashes(raw, ends[:-1], ends[1:], fold=False) ^ np.uint64(len(prefix))
        second = wordhash.span_hashes(255 - raw, ends[:-1], ends[1:], fold=False)
        numbers, known = np.zeros(len(strings), np.int32), np.zeros(len(strings), bool)
        if self._total:
            place = np.minimum(np.searchsorted(self._first, first), len(self._first) - 1)
            known = (self._first[place] == first) & (self._second[place] == second)
            numbers[known] = self._number[place[known]]
        new = np.flatnonzero(~known)
        numbers[new] = self._total + np.arange(len(new))
        self._total += len(new)
        found = strings.take(pa.array(new)).to_pylist()
        self._fresh.extend(map(prefix.__add__, found) if prefix else found)
        new = new[np.argsort(first[new], kind="stable")]
        at = np.searchsorted(self._first, first[new])
        self._first, self._second, self._number = (
            np.insert(x, at, y[new]) for x, y in ((self._first, first), (self._second, second), (self._number, numbers)))
        return numbers[np.array(coded.indices)]

    def piece_numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of all texts (null: empty) in order, and the offsets between texts."""
        texts = texts.fill_null("")
        odd = np.array(pc.match_substring_regex(texts, _RUN))
        plain = np.flatnonzero(~odd)
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(np.array(lists.offsets))
        others = []
        for row in np.flatnonzero(odd):
            parts = [x for x in _CUT.split(texts[int(row)].as_py()) if x]
            others += parts
            counts[row] = len(parts)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        numbers = np.zeros(offsets[-1], np.int32)
        if len(plain):
            flat = lists.flatten()
            own = self._of(flat, " ")
            heads = np.array(lists.offsets)[:-1] - lists.offsets[0].as_py()
            own[heads] = self._of(flat.take(pa.array(heads)))
            numbers[ranges(offsets[plain], counts[plain])] = own
        if others:
            rows = np.flatnonzero(odd)
            numbers[ranges(offsets[rows], counts[rows])] = self._of(pa.array(others, pa.string()))
        return numbers, offsets


class WordTable(PieceTable):
    """The words of texts by number. ``split`` gives the words of one piece of text."""

    def __init__(self, split):
        super().__init__()
        self.split = split
        self.words: list[str] = []
        self._word_numbers = _Numbers(self.words)
        self._starts, self._flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts (null: empty) in order, and the offsets between texts."""
        pieces, offsets = self.piece_numbers(texts)
        fresh, counts, flat = self.fresh(), [], []
        for low in range(0, len(fresh), SPLIT_AT_ONCE):
            split = list(map(self.split, fresh[low:low + SPLIT_AT_ONCE]))
            counts.append(np.fromiter(map(len, split), np.int64, len(split)))
            flat.append(self._word_numbers.of(list(chain.from_iterable(split))))
        if counts:
            self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(np.concatenate(counts))])
            self._flat = np.concatenate([self._flat, *flat])
        sizes = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.diff(self._starts)[pieces], out=sizes[1:])
        return gather(pieces, self._starts, self._flat), sizes[offsets]
