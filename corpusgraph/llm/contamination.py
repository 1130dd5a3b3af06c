"""Benchmark passages inside documents: Wu-Manber search for many word windows at once.

The alphabet is the words (ASCII letters, lower-cased, digits and characters beyond ASCII).
A window is ``size`` consecutive words of an item; an item of fewer, but not none, is one
window. Windows of one length share a search: a table gives for each block of
``BLOCK_WORDS`` words how far the search may move on, since no window ends before; where it may
not move, the buckets of windows with the same last and first block are taken, and each
window there is compared with the document byte by byte. Texts are cut into strips of
``STRIP`` possible ends, all strips of a batch move in step.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import wordhash
from corpusgraph.llm.chunks import ranges
from corpusgraph.llm.order import with_running_sum
from corpusgraph.llm.tasks import lean
from corpusgraph.plans.loops import cut, cut_counting

WINDOW = 10
BLOCK_WORDS = 2
STRIP = 256
#: Bytes of windows that one search holds at most (and one window); more are searched for in several passes over the documents.
BLOCK_BYTES = 16_000_000
#: Candidates compared at once.
CANDIDATES = 100_000
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {k: k + 32 for k in range(65, 91)}
_TIMES = np.uint64(0xD6E8FEB86659FD93)


def _block(value: np.ndarray, words: int) -> np.ndarray:
    """Hash of the blocks along the last axis, by their first word."""
    total = np.zeros(value.shape[:-1] + (value.shape[-1] - words + 1,), np.uint64)
    for k in range(words):
        total = total * _TIMES + value[..., k:value.shape[-1] - words + 1 + k]
    return wordhash.mixed(total)


class _Search:
    """The tables for windows of ``size`` words; ``hashes`` has a row per window."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.size = hashes.shape[1]
        self.block = min(BLOCK_WORDS, self.size)
        blocks = _block(hashes, self.block)
        last = self.size - self.block
        self.mask = np.uint64((1 << max(16, int(blocks.size * 8).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, last + 1, np.int32)
        for j in range(last + 1):  # a later block allows less, and is written over an earlier one
            self.shift[blocks[:, j] & self.mask] = last - j
        keys = self._key(blocks[:, -1], blocks[:, 0])
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], numbers[order]

    @staticmethod
    def _key(last, first):
        return wordhash.mixed(last * _TIMES + first)

    def _ends(self, value: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Positions at which the search may not move on: last words of possible windows."""
        counts = np.diff(firsts)
        long = np.flatnonzero(counts >= self.size)
        low, high = firsts[long] + self.size - 1, firsts[long + 1] - 1
        strips = (high - low) // STRIP + 1
        at = np.repeat(low, strips) + STRIP * ranges(np.zeros(len(strips), np.int64), strips)
        stop = np.minimum(at + STRIP - 1, np.repeat(high, strips))
        found = []
        while len(at):
            key = np.zeros(len(at), np.uint64)
            for k in range(self.block):
                key = key * _TIMES + value[at - (self.block - 1) + k]
            step = self.shift[wordhash.mixed(key) & self.mask]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at <= stop
            at, stop = at[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def candidates(self, value: np.ndarray, firsts: np.ndarray):
        """``(first words, window numbers)`` of possible occurrences, some at a time."""
        ends = self._ends(value, firsts)
        if not len(ends):
            return
        starts = ends - self.size + 1
        if len(value) < self.block:
            return
        blocks = _block(value, self.block)
        keys = self._key(blocks[ends - self.block + 1], blocks[starts])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = high > low
        starts, low, counts = starts[some], low[some], (high - low)[some]
        total, at = np.cumsum(counts), 0
        while at < len(counts):
            before = total[at - 1] if at else 0
            to = max(int(np.searchsorted(total, before + CANDIDATES, "right")), at + 1)
            yield np.repeat(starts[at:to], counts[at:to]), self.numbers[ranges(low[at:to], counts[at:to])]
            at = to


class Windows:
    """Windows (texts of words joined by one space), the searches for them, and the items that hold them."""

    def __init__(self, windows: list[str], items: list[str]):
        self.items = sorted(set(items))
        place = {x: k for k, x in enumerate(self.items)}
        texts = sorted(set(windows))
        number = {x: k for k, x in enumerate(texts)}
        owner = np.fromiter((number[w] for w in windows), np.int64, len(windows))
        held = np.fromiter((place[i] for i in items), np.int64, len(items))
        order = np.argsort(owner, kind="stable")
        self.held = held[order]
        self.held_starts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
        raw, ends = wordhash.text_bytes(pa.array(texts, pa.string()))
        begin, end = wordhash.word_spans(raw, ends, wordhash.SIGNS)
        firsts = np.searchsorted(begin, ends)
        value = wordhash.span_hashes(raw, begin, end)
        #: the words' lengths and bytes without the spaces, for the comparison
        self.lengths, self.firsts = end - begin, firsts
        self.bytes = raw[ranges(begin, end - begin)]
        self.byte_starts = np.append(0, np.cumsum(end - begin))[firsts]
        sizes = np.diff(firsts)
        self.searches = []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            self.searches.append(_Search(value[firsts[rows][:, None] + np.arange(size)], rows))

    def occurrences(self, raw, begin, end, value, firsts):
        """``(first word, window, size)`` arrays of every occurrence in the words of some texts."""
        out = []
        for search in self.searches:
            for start, window in search.candidates(value, firsts):
                same = self._equal(raw, begin, end, start, window, search.size)
                out.append((start[same], window[same], np.full(int(same.sum()), search.size)))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def _equal(self, raw, begin, end, start, window, size):
        at = start[:, None] + np.arange(size)
        same = (end[at] - begin[at] == self.lengths[self.firsts[window][:, None] + np.arange(size)]).all(axis=1)
        rows = np.flatnonzero(same)
        if len(rows):
            at = at[rows].ravel()
            mine = wordhash.LOWER[raw[ranges(begin[at], end[at] - begin[at])]]
            first, to = self.byte_starts[window[rows]], self.byte_starts[window[rows] + 1]
            theirs = self.bytes[ranges(first, to - first)]
            same[rows] = np.logical_and.reduceat(mine == theirs, np.append(0, np.cumsum(to - first)[:-1]))
        return same


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``(item, window)`` of ``items (id, text)``: the id as text, the words joined by one space."""
    @lean
    def cut_up(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = WORD.findall((text or "").translate(_FOLD))
                for k in range(max(len(words) - size + 1, min(len(words), 1))):
                    names.append(name)
                    texts.append(" ".join(words[k:k + size]))
                    if len(names) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item", "window"])
                        names, texts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item", "window"])

    id_, text = items.columns[:2]
    rows = items.select(F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut_up, "item string, window string").distinct()


def _scanner(windows: Windows):
    @lean
    def scan(batches):
        for batch in batches:
            for at, to, raw, ends in wordhash.chunks(batch.column("text")):
                begin, end = wordhash.word_spans(raw, ends, wordhash.SIGNS)
                firsts = np.searchsorted(begin, ends)
                value = wordhash.span_hashes(raw, begin, end)
                start, window, size = windows.occurrences(raw, begin, end, value, firsts)
                hit = np.zeros(len(begin) + 1, np.int64)
                np.add.at(hit, start, 1)
                np.add.at(hit, start + size, -1)
                hit = np.cumsum(hit[:-1]) > 0
                edge = np.zeros(len(begin) + 1, bool)
                edge[firsts] = True
                joined = hit.copy()  # a hit word whose run goes on from the word before
                joined[1:] &= hit[:-1]
                joined[:1] = False
                joined &= ~edge[:-1]
                opens = np.flatnonzero(hit & ~joined)
                sizes = np.diff(np.append(np.cumsum(hit)[opens] - 1, hit.sum()))
                text = np.searchsorted(firsts, opens, "right") - 1
                # one entry per text and window, then per text and item
                pair = np.unique(np.stack([np.searchsorted(firsts, start, "right") - 1, window], axis=1), axis=0) if len(start) else \
                    np.zeros((0, 2), np.int64)
                counts = np.diff(windows.held_starts)[pair[:, 1]]
                item = windows.held[ranges(windows.held_starts[pair[:, 1]], counts)]
                met = np.unique(np.repeat(pair[:, 0], counts) * len(windows.items) + item)
                of, item = met // max(len(windows.items), 1), met % max(len(windows.items), 1)
                rows = np.arange(to - at + 1)
                part = batch.slice(at, to - at)
                spans = pa.StructArray.from_arrays([pa.array(opens - firsts[text]), pa.array(sizes)], ["first", "words"])
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("tkey"), pa.array(np.diff(firsts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(text, rows), pa.int32()), spans),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, rows), pa.int32()),
                                             pa.array([windows.items[k] for k in item], pa.string()))],
                    ["id", "tkey", "n_words", "spans", "items"])
    return scan


@lean
def _merge(batches):
    """Runs found by several passes as disjoint runs in order."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged = []
            for first, to in sorted((x["first"], x["first"] + x["words"]) for x in spans):
                if merged and first <= merged[-1][1]:
                    merged[-1][1] = max(to, merged[-1][1])
                else:
                    merged.append([first, to])
            out.append([{"first": a, "words": b - a} for a, b in merged])
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(out, batch.column("spans").type))


def find_windows(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where windows of ``items (id, text)`` occur in ``docs (id, text)``: one row per document row.

    ``id, n_words``, ``spans``: the disjoint runs of words that lie in any occurrence, as ``(first, words)`` from 0 on, and
    ``items``: ids, as text and sorted, of the items with an occurring window. Runs that touch are one run.

    The first two columns count, whatever their names; others may clash and are left out. Null and
    empty texts and texts without words have no words and no windows. Items without an id are
    one item whose name is empty; rows of one id are one item, but windows never span two rows.
    Equal document rows have equal results. Windows go to the driver and to tasks in
    blocks of ``block_bytes``; each further block is one more pass over the documents.
    """
    id_, text = docs.columns[:2]
    rows = docs.select(F.col(id_).alias("id"), F.lit(None).cast("binary").alias("tkey"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, tkey binary, n_words long, spans array<struct<first:long,words:long>>, items array<string>"
    windows, _ = cut_counting(item_windows(items, size))
    weight = F.octet_length("window") + F.octet_length("item") + 16
    total = windows.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]

    def searched(block: DataFrame, table: DataFrame) -> DataFrame:
        held = block.select("window", "item").toArrow()
        known = Windows(held.column("window").to_pylist(), held.column("item").to_pylist())
        return table.mapInArrow(_scanner(known), schema)

    if total <= block_bytes:
        return searched(windows, rows).drop("tkey")
    placed = cut(with_running_sum(windows, [F.col("window"), F.col("item")], weight, "before").withColumn(
        "block", F.floor(F.col("before") / block_bytes)))
    keyed = rows.withColumn("tkey", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    numbers, parts = [x["block"] for x in placed.select("block").distinct().orderBy("block").collect()], None
    for number in numbers:
        part = cut(searched(placed.filter(F.col("block") == number), keyed))
        parts = part if parts is None else parts.unionByName(part)
    met = parts.groupBy("id", "tkey").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / len(numbers)).cast("int").alias("copies"))
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("id", "tkey", "n_words", "spans", "items")
    return each.mapInArrow(_merge, schema).drop("tkey")
