"""One-permutation MinHash fingerprints of documents."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm import wordhash
from corpusgraph.llm.tasks import lean
from corpusgraph.plans.loops import cut

BINS = 256
BITS = 4
ROWS = 512
_EMPTY = np.uint64(2**64 - 1)


def one_permutation(value: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value per bin and set: each hash falls into one bin by its high bits, the least one stays.

    Empty bins are filled by optimal densification: bin i tries bins drawn from a hash of
    (i, attempt), the same for every set, until it meets one that was not empty, and copies
    it. Rows of empty sets stay without values.
    """
    sets = len(offsets) - 1
    best = np.full(sets * bins, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    slot = (((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(best, owner * bins + slot, wordhash.mixed(value) >> np.uint64(1))
    best = best.reshape(sets, bins)
    empty = best == _EMPTY
    filled, open_rows = best.copy(), np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    rows, columns = np.nonzero(empty[open_rows])
    rows = open_rows[rows]
    attempt = 0
    while len(rows):
        draw = wordhash.mixed(np.arange(bins, dtype=np.uint64) + np.uint64((attempt + 1) * 0x9E3779B97F4A7C15 % 2**64))
        source = (((draw >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)[columns]
        found = ~empty[rows, source]
        filled[rows[found], columns[found]] = best[rows[found], source[found]]
        rows, columns = rows[~found], columns[~found]
        attempt += 1
    return filled


def low_bits(texts: pa.Array, words: int = 5, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of every bin for each text, and whether the text has a shingle at all."""
    out, some = np.zeros((len(texts), bins), np.uint8), np.zeros(len(texts), bool)
    for at, to, raw, ends in wordhash.chunks(texts):
        value, offsets = wordhash.runs(*wordhash.words(raw, ends), words)
        out[at:to] = one_permutation(value, offsets, bins).astype(np.uint8) & np.uint8(2**bits - 1)
        some[at:to] = np.diff(offsets) > 0
    out[~some] = 0
    return out, some


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex of the low bits side by side; the empty string for a text without shingles."""
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint8)
    flat = np.packbits(((low[:, :, None] >> shifts) & 1).reshape(len(low), -1), axis=1) if len(low) else low
    return [x.tobytes().hex() if s else "" for x, s in zip(flat, some)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness: the share of equal bins without the share that is equal by chance."""
    chance = 2.0 ** -bits
    raw = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, raw, (~some_a & ~some_b).astype(float))


def _described(ids: pa.Array, texts: list, following: list, words: int) -> pa.RecordBatch:
    """Result rows; ``following[i]`` is the text after ``texts[i]`` in the order."""
    halves = [len(t) // 2 for t in texts]
    edited = [t[:len(t) - h] + f[:h] for t, f, h in zip(texts, following, halves)]
    own, own_some = low_bits(pa.array(texts, pa.large_string()), words)
    new, new_some = low_bits(pa.array(edited, pa.large_string()), words)
    if len(texts) > 1 and all(x is y for x, y in zip(following, texts[1:])):
        last, last_some = low_bits(pa.array(following[-1:], pa.large_string()), words)
        nxt, nxt_some = np.concatenate([own[1:], last]), np.concatenate([own_some[1:], last_some])
    else:
        nxt, nxt_some = low_bits(pa.array(following, pa.large_string()), words)
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(packed(own, own_some), pa.string()), pa.array(packed(new, new_some), pa.string()),
        pa.array(likeness(own, new, own_some, new_some)), pa.array(likeness(own, nxt, own_some, nxt_some))],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _walker(words: int):
    """Result rows of all documents of a sorted range but its last, then one edge row: the first text and the last document."""
    @lean
    def walk(batches):
        part, first, held_id, held_text, kind = TaskContext.get().partitionId(), None, None, None, None
        for batch in batches:
            kind = batch.schema.field("id").type
            for low in range(0, batch.num_rows, ROWS):
                cut_out = batch.slice(low, ROWS)
                ids, texts = cut_out.column("id").to_pylist(), cut_out.column("text").to_pylist()
                if first is None:
                    first = texts[0]
                else:
                    ids, texts = [held_id, *ids], [held_text, *texts]
                held_id, held_text = ids[-1], texts[-1]
                if len(texts) > 1:
                    rows = _described(pa.array(ids[:-1], kind), texts[:-1], texts[1:], words)
                    empty = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.string(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *empty], [*rows.schema.names, "part", "first", "last"])
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held_id], kind), *[pa.nulls(1, t) for t in (
                    pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())],
                 pa.array([part], pa.int32()), pa.array([first]), pa.array([held_text])],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "first", "last"])
    return walk


def _edge_describer(words: int):
    @lean
    def run(batches):
        for batch in batches:
            yield _described(batch.column("id"), batch.column("last").to_pylist(), batch.column("first").to_pylist(), words)
    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    Word shingles (``words`` words, A-Z folded; a shorter text is one shingle) are hashed once
    into 256 bins (:func:`one_permutation`), of which 4 low bits are stored: 256 hex digits.
    ``near_*`` is the share of equal bins, corrected for chance.

    The edited text has its last floor(n / 2) code points replaced by the first as many of
    the next document, by descending id (null ids last, ties by a hash of the text; after
    the last comes the first). Documents are sorted into ranges, the only shuffle of texts;
    a task streams through its range holding one document back. What spans two ranges, one
    document per range, is joined by range number afterwards.

    A null text is an empty text. A text without words has the empty fingerprint; two such
    are alike (1), one such and another are not (0). Repeated rows are documents of their
    own. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    shape = (f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    walked = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").mapInArrow(
        _walker(words), f"{shape}, part int, first string, last string"))
    edges = cut(walked.filter("part IS NOT NULL").select("id", "part", "first", "last"))
    places = edges.select("part", (F.row_number().over(Window.orderBy("part")) - 1).alias("place"))
    places = cut(places.withColumn("next", (F.col("place") + 1) % F.greatest(F.lit(edges.count()), F.lit(1))))
    heads = edges.join(places, "part").select(F.col("place").alias("next"), "first")
    met = edges.drop("first").join(places, "part").join(heads, "next").select("id", "last", "first")
    names = [x.split()[0] for x in shape.split(", ")]
    return walked.filter("part IS NULL").select(*names).unionByName(met.mapInArrow(_edge_describer(words), shape))
