"""Hashes of words and of runs of words, for whole Arrow batches at a time.

A word is a run of bytes other than space and the controls 9 to 13; ``A-Z`` are folded
to lower case on request. All texts of a batch are hashed in one pass over their UTF-8 bytes: a
word's hash is the sum of random 64-bit values of its bytes times powers of an odd
number, taken from prefix sums, then mixed with its length.
"""

import numpy as np
import pyarrow as pa

_RANDOM = np.random.Generator(np.random.PCG64(20_240_501))
BYTE_VALUES = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII letters and digits and the bytes of other characters.
SIGNS = np.ones(256, bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(STEP), -1, 2**64))
    up, down = np.full(n, STEP, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = ONE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(CHUNK_BYTES + 1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the offsets between them."""
    large = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    if large.null_count:
        large = large.fill_null("")
    _, offsets, data = large.buffers()
    ends = np.frombuffer(offsets, np.int64)[large.offset:large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def word_spans(raw: np.ndarray, ends: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word in order, and the byte behind it. No word spans two texts."""
    n = len(raw)
    gap = separator[raw]
    inside = ~gap
    starts = inside.copy()
    starts[1:] &= gap[:-1] | False
    first = ends[:-1][ends[:-1] < n]
    starts[first] = inside[first]
    stops = inside.copy()
    stops[:-1] &= gap[1:]
    last = ends[1:][(ends[1:] > 0)] - 1
    stops[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of every word ``raw[begin[k]:end[k]]``."""
    n = len(raw)
    if n > CHUNK_BYTES:
        up, down = _powers(n + 1)
    else:
        up, down = _UP, _DOWN
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[LOWER[raw] if fold else raw] * up[:n], out=sums[1:])
    value = (sums[end] - sums[begin]) * down[begin]
    return mixed(value + (end - begin).astype(np.uint64) * STEP)


def words(raw: np.ndarray, ends: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and per text the number of its first word (one more entry at the end)."""
    begin, end = word_spans(raw, ends)
    return span_hashes(raw, begin, end, fold), np.searchsorted(begin, ends)


def runs(value: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a text; a text with fewer words is one run.

    Returns the hashes and per text the number of its first run (one more at the end).
    """
    counts = np.diff(firsts)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=offsets[1:])
    out = np.zeros(offsets[-1], np.uint64)
    long = np.flatnonzero(counts >= size)
    if len(long):
        at = np.repeat(firsts[long] - offsets[long], made[long]) + _ranges(offsets[long], made[long])
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            total = total * np.uint64(0xD6E8FEB86659FD93) + value[at + k]
        out[_ranges(offsets[long], made[long])] = mixed(total)
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        total = np.uint64(counts[t])
        with np.errstate(over="ignore"):
            for v in value[firsts[t]:firsts[t + 1]]:
                total = total * np.uint64(0xD6E8FEB86659FD93) + v
        out[offsets[t]] = mixed(np.array([total ^ STEP], np.uint64))[0]
    return out, offsets


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    where = np.zeros(total, np.int64)
    if total:
        stops = np.cumsum(length)
        where += 1
        where[0] = begin[0]
        heads = stops[:-1][length[1:] > 0]
        where[heads] = (begin[1:] - (begin[:-1] + length[:-1]) + 1)[length[1:] > 0]
        np.cumsum(where, out=where)
    return where


def chunks(texts: pa.Array, size: int = CHUNK_BYTES):
    """Slices of the batch of about ``size`` bytes each: ``(first row, last row, raw, ends)``."""
    raw, ends = text_bytes(texts)
    at, n = 0, len(ends) - 1
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
        at = to


def distinct_per_text(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text and the offsets between texts."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(offsets)))
