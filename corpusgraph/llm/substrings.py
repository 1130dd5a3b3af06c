"""Removal of passages that earlier documents hold already, by sliding runs of sentences."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import wordhash
from corpusgraph.llm.tasks import lean

#: Words a run of sentences has at least (letters, in scripts without spaces); a run is as short as that allows.
LEAST_WORDS = 30
#: What lies between two sentences: a line break, white space after an end mark, an end mark that needs no white space
#: behind it, or white space in scripts that have it between phrases only (Thai, Lao, Khmer, Burmese).
_GAP = re.compile(r"\s*\n\s*|(?<=[.!?…])\s+|(?<=[。！？])\s*|(?<=[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff])\s+")
_MULTIPLIERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407))


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of every sentence; white space around them belongs to none."""
    out, begin = [], 0
    for gap in _GAP.finditer(text):
        if gap.start() > begin:
            out.append((begin, gap.start()))
        begin = gap.end()
    if begin < len(text):
        out.append((begin, len(text)))
    return [x for x in out if not text[x[0]:x[1]].isspace()]


def _units(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and per text the number of its first one; each letter of a script without spaces is a word.

    Such letters are known by their first bytes: kana and Han, Thai and Lao, Burmese, Khmer.
    """
    begin, end = wordhash.word_spans(raw, ends)
    if len(raw) and raw.max() >= 0xE0:
        then = np.append(raw[1:], np.uint8(0))
        wide = (raw >= 0xE3) & (raw <= 0xE9) | (raw == 0xEF) & (then >= 0xA4) & (then <= 0xAB)
        thai = (raw == 0xE0) & (then >= 0xB8) & (then <= 0xBB)
        others = (raw == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then >= 0x9E) & (then <= 0x9F))
        rare = (raw == 0xF0) & (then >= 0xA0) & (then <= 0xAF)
        heads = np.flatnonzero(wide | thai | others | rare)
        cuts = np.union1d(heads, heads + np.where(rare[heads], 4, 3))
        word = np.searchsorted(begin, cuts, "right") - 1
        cuts = cuts[(word >= 0) & (cuts < end[word])]
        parts = np.union1d(begin, cuts)
        end = np.minimum(end[np.searchsorted(begin, parts, "right") - 1], np.append(parts[1:], len(raw)))
        begin = parts
    return wordhash.span_hashes(raw, begin, end, fold=False), np.searchsorted(begin, ends)


def _run_hashes(value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the words ``begin[k] .. end[k] - 1`` for every k, whatever sentences they lie in."""
    out = []
    for step in _MULTIPLIERS:
        up, down = (np.full(len(value) + 1, x, np.uint64) for x in (step, np.uint64(pow(int(step), -1, 2**64))))
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * up[:-1], out=sums[1:])
        out.append(wordhash.mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
    return out


def runs_of(texts: list[str], least: int):
    """Runs of sentences of all texts: ``(text, first, last + 1, hash, second hash, again)`` as arrays.

    From each sentence on, the shortest run of at least ``least`` words, and to each sentence
    the shortest such run that ends there. Together these lie in every stretch of that many
    words and cover it. ``again``: the text held the same run before.
    """
    spans = [sentences(t) for t in texts]
    counts = np.fromiter(map(len, spans), np.int64, len(spans))
    heads = np.concatenate([[0], np.cumsum(counts)])
    flat = pa.array([t[a:b] for t, own in zip(texts, spans) for a, b in own], pa.large_string())
    raw, ends = wordhash.text_bytes(flat)
    value, firsts = _units(raw, ends)
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.arange(heads[-1])
    stop = np.searchsorted(firsts, firsts[begin] + least)
    good = stop <= heads[owner + 1]
    forward = np.stack([begin[good], stop[good]])
    last = begin + 1
    start = np.searchsorted(firsts, firsts[last] - least, "right") - 1
    good = (start >= heads[owner]) & (firsts[last] >= least)
    both = np.unique(np.concatenate([forward, np.stack([start[good], last[good]])], axis=1), axis=1)
    begin, stop = both
    owner = owner[begin]
    first, second = _run_hashes(value, firsts[begin], firsts[stop])
    order = np.lexsort((begin, first, owner))
    again = np.zeros(len(begin), bool)
    again[order[1:]] = (first[order][1:] == first[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return owner, begin - heads[owner], stop - heads[owner], first.view(np.int64), second.view(np.int64), again


def _slices(batch, rows: int = 512):
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def _lister(least: int):
    @lean
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                owner, begin, stop, first, second, again = runs_of(part.column("text").to_pylist(), least)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(at), part.column("th").take(at), pa.array(first), pa.array(second),
                    pa.array(begin << 32 | stop), pa.array(again)], ["id", "th", "h", "h2", "span", "again"])
    return run


@lean
def _remover(batches):
    for batch in batches:
        for part in _slices(batch):
            out = []
            for text, covered in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                spans = sentences(text)
                gone = np.zeros(len(spans) + 1, np.int64)
                for span in covered or ():
                    gone[span >> 32] += 1
                    gone[span & 0xFFFFFFFF] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                if gone.any():
                    ends = [a for a, _ in spans[1:]] + [len(text)]
                    kept = text[:spans[0][0]] + "".join(text[a:e] for (a, _), e, g in zip(spans, ends, gone) if not g)
                    out.append((kept.rstrip(), len(spans), int(gone.sum())))
                else:
                    out.append((text, len(spans), 0))
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.int64())], ["id", "text", "n_sentences", "n_removed"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Texts without the sentences that a non-first repeated run covers: ``id, text, n_sentences, n_removed``.

    Every run of consecutive sentences (:func:`runs_of`) is hashed and grouped over all documents;
    the first holder is the document with the least id, and inside it the first place. All
    other places of that run lose its sentences. Two independent hashes must agree, so a
    chance match of one removes nothing.

    Groups are counted before they meet the places again, so a passage that a third of the
    documents share is one row on one side of a join that Spark can split.

    A null text is empty. Documents with fewer than ``least_words`` words have no runs and stay
    as they are, as does every text without a repeat, to the byte. Null ids come last;
    documents without an id, or with the same one, do not count as repeats of one another, and
    repeated rows are treated alike. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    places = rows.mapInArrow(_lister(least_words), f"id {kind}, th bigint, h bigint, h2 bigint, span bigint, again boolean")
    repeated = places.groupBy("h").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n"), F.min("h2").alias("low"), F.max("h2").alias("high")).filter(
        "n > 1 AND low = high").select("h", "first_id")
    later = F.col("again") | (F.col("id") > F.col("first_id")) | (F.col("id").isNull() & F.col("first_id").isNotNull())
    covered = places.join(repeated, "h").filter(later).groupBy("id", "th").agg(F.collect_set("span").alias("spans")).withColumnsRenamed(
        {"id": "id2", "th": "th2"})
    met = rows.join(covered, (F.col("th") == F.col("th2")) & F.col("id").eqNullSafe(F.col("id2")), "left")
    return met.select("id", "text", "spans").mapInArrow(_remover, f"id {kind}, text string, n_sentences bigint, n_removed bigint")
