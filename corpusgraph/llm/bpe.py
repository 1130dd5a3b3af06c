"""Byte-level BPE by ranked merges, folded with Spark's higher-order functions."""

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import wordhash
from corpusgraph.llm.chunks import WordTable, gather, ranges
from corpusgraph.llm.tasks import giving_back, lean
from corpusgraph.plans.loops import cut, cut_dealt

#: Rows, and characters of text, whose distinct words are listed together, and rows split at once.
BLOCK_ROWS = 8192
BLOCK_CHARACTERS = 16_000_000
SPLIT_ROWS = 256
#: Words, counted once per block, that a share of the words holds on average.
SHARE_WORDS = 500_000
#: Bits of a piece and of the rank of a pair in a fold's state; the place of a piece has the bits between.
BITS, PLACE_BITS = 18, 27
#: Rank of pieces that do not join.
NONE = 2**BITS - 1


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 bytes and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def merge_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The rank map of neighbouring pieces as two arrays of fixed size.

    ``cells[shift[a] + b] = a * 2**BITS + rank`` if pieces a and b (by rank) join to a piece of that
    rank; other cells hold another a or ``NONE``. Rows are laid over one another, longest first, each
    at a shift at which its cells are free; where there is none the table grows. One piece more than
    there are, the last of ``shift``, joins with none.
    """
    ranks = read_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    size = max(ranks.values()) + 1
    shift, cells = np.zeros(size + 1, np.int64), np.full(3 * sum(map(len, rows.values())) + size + 1, NONE, np.int64)
    free = np.ones(len(cells), bool)
    random = np.random.Generator(np.random.PCG64(11))
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b, rank = (np.array(x, np.int64) for x in zip(*sorted(row)))
        while (at := _free_shift(free, b, len(free) - size, random)) is None:
            cells, free = np.append(cells, np.full(size, NONE)), np.append(free, np.ones(size, bool))
        shift[a] = at
        cells[at + b], free[at + b] = a * 2**BITS + rank, False
    return shift, cells


def _free_shift(free: np.ndarray, keys: np.ndarray, shifts: int, random: np.random.Generator) -> int | None:
    """A shift below ``shifts`` at which all ``keys`` meet free cells: one of some random ones, else the least of all."""
    for n in (32, 1024, 32_768, shifts):
        tried = np.arange(shifts) if n >= shifts else random.integers(0, shifts, n)
        for key in keys:
            tried = tried[free[tried + key]]
        if len(tried):
            return int(tried[0])
    return None


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_word(letters: Column, shift: Column, cells: Column, border: int) -> Column:
    """Ids of one word given as the ranks of its single bytes.

    The fold's state is one number per piece: from the top the rank of the pair that it makes with
    the next one (``NONE``: they do not join), its place in the word and the piece. So the least
    number is the first pair of least rank, which is the rank of the joint piece too. Each step
    joins it and looks up the two pairs that it makes. A ``border`` piece (the last of ``shift``)
    that joins with none stands on both sides. A state without ranks stays.
    """
    top, piece_of, place_of = BITS + PLACE_BITS, _long(NONE), _long((2**PLACE_BITS - 1) << BITS)

    def pair(a: Column, b: Column) -> Column:
        cell = F.get(cells, (F.get(shift, a.cast("int")) + b).cast("int"))
        return F.shiftleft(F.least(cell.bitwiseXOR(F.shiftleft(a, BITS)), _long(NONE)), top)

    def piece(state: Column, at: Column) -> Column:
        return F.get(state, at).bitwiseAND(piece_of)

    size = F.size(letters)
    start = F.flatten(F.array(
        F.array(_long(NONE << top | border)),
        F.transform(letters, lambda a, i: pair(a, F.coalesce(F.get(letters, i + 1), _long(border))).bitwiseOR(
            F.shiftleft((i + 1).cast("bigint"), BITS)).bitwiseOR(a)),
        F.array(_long(NONE << top | (2**PLACE_BITS - 1) << BITS | border))))

    def merge(state: Column, low: Column, at: Column) -> Column:
        joint, before = F.shiftright(low, top), F.get(state, at - 2)
        return F.flatten(F.array(
            F.slice(state, F.lit(1), at - 2),
            F.array(
                pair(before.bitwiseAND(piece_of), joint).bitwiseOR(before.bitwiseAND(_long(2**top - 1))),
                pair(joint, piece(state, at + 1)).bitwiseOR(low.bitwiseAND(place_of)).bitwiseOR(joint)),
            F.slice(state, at + 2, F.size(state))))

    def step(state: Column, _: Column) -> Column:
        return _with(F.array_min(state), lambda low: F.when(low >= _long(NONE << top), state).otherwise(
            _with(F.array_position(state, low).cast("int"), lambda at: merge(state, low, at))))

    folded = F.aggregate(F.sequence(F.lit(2), size), start, step, lambda s: F.transform(
        F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(piece_of)))
    return F.when(size < 2, letters).otherwise(folded)


def _blocks(pattern: str):
    """Rows to blocks: some documents a row as word numbers, then a row with the distinct words as their bytes and sizes."""
    split = regex.compile(pattern).findall

    def row(block, n_words, raw, sizes, ids, numbers, lengths):
        return pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.array([n_words], pa.int64()), pa.array([raw], pa.binary()), pa.array([sizes], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([numbers], pa.binary()), pa.array([lengths], pa.binary())],
            ["block", "n_words", "raw", "sizes", "ids", "numbers", "lengths"])

    @lean
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            low = 0
            sizes = np.array(pc.utf8_length(batch.column("text")).fill_null(0))
            while low < batch.num_rows:
                stop = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:low + BLOCK_ROWS]), BLOCK_CHARACTERS, "right")))
                stop = min(stop, batch.num_rows)
                words = WordTable(split)
                for first in range(low, stop, SPLIT_ROWS):
                    part = batch.slice(first, min(SPLIT_ROWS, stop - first))
                    numbers, offsets = words.numbers(part.column("text"))
                    yield row(block, 0, None, None, part.column("id"), _planes(numbers), np.diff(offsets).astype("<u4").tobytes())
                raw, ends = wordhash.text_bytes(pa.array(words.words, pa.string()))
                yield row(block, len(words.words), raw.tobytes(), np.diff(ends).astype("<u4").tobytes(), batch.column("id").slice(0, 0), None, None)
                block += 1
                low = stop
    return run


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then their second bytes and so on: this packs better."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(value: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(_numbers(value, "u1").reshape(4, -1).T).view("<i4").ravel()


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(value: pa.Scalar, kind: str, size: int) -> np.ndarray:
    """``size`` packed numbers."""
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(value.as_buffer(), int(size) * kind.itemsize, "zstd"), kind)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return ends


def _numbers(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _share_order(raw: np.ndarray, sizes: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of every word, by hash, and the words in the order of their shares."""
    ends = _offsets(sizes)
    share = (wordhash.span_hashes(raw, ends[:-1], ends[1:], fold=False) >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
    return share.astype(np.int64), np.argsort(share, kind="stable")


def _deal(shares: int):
    """The words of a block to their shares of all words."""
    @lean
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw, sizes = _numbers(batch.column("raw")[row], "u1"), _numbers(batch.column("sizes")[row], "<u4")
                share, order = _share_order(raw, sizes, shares)
                ends = _offsets(sizes)
                raw, sizes = raw[ranges(ends[order], sizes[order].astype(np.int64))], sizes[order]
                ends, found, firsts = _offsets(sizes), *np.unique(share[order], return_index=True)
                spans = [*zip(firsts.tolist(), [*firsts[1:].tolist(), len(order)])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(found, pa.int64()), pa.array([batch.column("block")[row].as_py()] * len(found), pa.int64()),
                    pa.array([_pack(raw[ends[a]:ends[b]]) for a, b in spans], pa.binary()),
                    pa.array([sizes[a:b].tobytes() for a, b in spans], pa.binary())], ["share", "block", "raw", "sizes"])
    return run


def _distinct(path: str):
    """A share of the words: those that differ as ranks of their bytes, and each block's as numbers of these.

    A word that has a rank itself is listed as that one rank. The rank map (:func:`merge_table`) goes with each share:
    in the plan the driver would keep its text many times over.
    """
    def listed_once(table: pa.Table) -> pa.Table:
        ranks = read_ranks(path)
        single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        sizes = [_numbers(x, "<u4") for x in table.column("sizes")]
        ends = _offsets(np.concatenate(sizes))
        raw = b"".join(_unpack(x, "u1", n.sum()) for x, n in zip(table.column("raw"), sizes))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        words, numbers = coded.dictionary.to_pylist(), np.array(coded.indices).astype("<i4")
        whole = np.fromiter((ranks.get(w, -1) for w in words), np.int64, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        letters, first = single[np.frombuffer(b"".join(words), np.uint8)], _offsets(length)[:-1]
        listed, has = np.repeat(whole < 0, length), whole >= 0
        listed[first[has]], letters[first[has]] = True, whole[has]
        place = _offsets([len(x) for x in sizes])
        return pa.table([
            table.column("share").slice(0, 1).combine_chunks(),
            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.ListArray.from_arrays(
                pa.array(_offsets(np.where(has, 1, length)), pa.int32()), pa.array(letters[listed]))),
            pa.array([table.column("block").to_pylist()], pa.list_(pa.int64())),
            pa.array([[_planes(numbers[a:b]) for a, b in zip(place, place[1:])]], pa.list_(pa.binary())),
            *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in merge_table(path))],
            ["share", "words", "blocks", "numbers", "shift", "cells"])

    def run(table: pa.Table) -> pa.Table:
        with giving_back():
            return listed_once(table)
    return run


def _hand_back(kind: str):
    """The ids of a share's words to the blocks that hold them."""
    @lean
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                coded = batch.column("coded")[row].values
                starts = np.array(coded.offsets, np.int64)
                starts = starts - starts[0]
                flat = np.array(coded.flatten(), np.int64).astype(kind)
                share = batch.column("share")[row].as_py()
                for block, numbers in zip(batch.column("blocks")[row].values, batch.column("numbers")[row].values):
                    own = _from_planes(numbers)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block.as_py()], pa.int64()), pa.array([share], pa.int64()),
                        pa.array([np.diff(starts)[own].astype("<u4").tobytes()], pa.binary()),
                        pa.array([_pack(gather(own, starts, flat))], pa.binary())], ["block", "share", "counts", "coded"])
    return run


@lru_cache(maxsize=2)
def _pieces(path: str) -> list:
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ids stand for: their pieces one after another."""
    return b"".join(map(_pieces(path).__getitem__, ids.tolist()))


def _assemble(path: str, shares: int, kind: str, digest_ids: bool, digest_decoded: bool):
    """A block and the ids of its words back to documents."""
    def documents(block: pa.Table, handed: pa.Table) -> pa.Table:
        handed = handed.sort_by("share")
        dealt = [_numbers(x, "<u4").astype(np.int64) for x in handed.column("counts")]
        flat = np.concatenate([np.zeros(0, kind), *(_unpack(x, kind, n.sum()) for x, n in zip(handed.column("coded"), dealt))])
        dealt = np.concatenate([np.zeros(0, np.int64), *dealt])
        starts, counts = np.zeros(len(dealt), np.int64), np.zeros(len(dealt), np.int64)
        for raw, sizes in zip(block.column("raw"), block.column("sizes")):
            if raw.is_valid:
                order = _share_order(_numbers(raw, "u1"), _numbers(sizes, "<u4"), shares)[1]
                starts[order], counts[order] = _offsets(dealt)[:-1], dealt
        tables = []
        for ids, numbers, lengths in zip(block.column("ids"), block.column("numbers"), block.column("lengths")):
            if not numbers.is_valid:
                continue
            words, ends = _from_planes(numbers), _offsets(_numbers(lengths, "<u4"))
            own = [flat[ranges(starts[x], counts[x])].astype("<u4") for x in (words[a:b] for a, b in zip(ends, ends[1:]))]
            raw = [x.tobytes() for x in own]
            back = [decode(x, path) for x in own]
            raw, back = (pa.array([hashlib.sha256(x).hexdigest() for x in values]) if hashed else pa.array(values, pa.binary())
                         for values, hashed in ((raw, digest_ids), (back, digest_decoded)))
            tables.append(pa.table([ids.values, pa.array([len(x) for x in own], pa.int64()), raw, back], ["id", "n_tokens", "ids", "decoded"]))
        return pa.concat_tables(tables)

    def run(block: pa.Table, handed: pa.Table) -> pa.Table:
        with giving_back():
            return documents(block, handed)
    return run


def _coded_words(blocks: DataFrame, shares: int, path: str, kind: str) -> DataFrame:
    """``block, share, counts, coded``: the ids of each block's words, by share."""
    words = blocks.filter("raw IS NOT NULL").select("block", "raw", "sizes").mapInArrow(_deal(shares), "share bigint, block bigint, raw binary, sizes binary")
    distinct = words.groupBy("share").applyInArrow(
        _distinct(path), (
            "share bigint, words array<array<bigint>>, blocks array<bigint>, numbers array<binary>, shift array<bigint>, cells array<bigint>"))
    border = max(read_ranks(path).values()) + 1
    # one lambda variable holds the rank map, so that it is read from the row once and not at every look-up
    coded = distinct.select("share", "blocks", "numbers", F.get(F.transform(
        F.array(F.struct("shift", "cells")), lambda table: F.transform(
            "words", lambda w: fold_word(w, table["shift"], table["cells"], border))), F.lit(0)).alias("coded"))
    # written, so that a core has one Python worker at a time: first those that list, then those that hand back
    return cut(coded).mapInArrow(_hand_back(kind), "block bigint, share bigint, counts binary, coded binary")


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
                 digest: bool = False, digest_decoded: bool = False) -> DataFrame:
    """Ids of every text and the bytes that they decode to.

    A task takes a block of its documents, lists their distinct words (matches of ``pattern``) once and
    writes the block, dealt by its number. Words, not texts, are shuffled: into shares by hash, where each distinct
    word of the whole table is folded once in the JVM (:func:`fold_word`), and their ids back to the blocks,
    which give the ids of each document by word number. No broadcast. A block is bounded in rows and characters; a
    longer text is a block of its own. The number of shares grows with the words of the blocks.

    Returns ``id, n_tokens, ids, decoded``: ids as little-endian unsigned 32-bit numbers and bytes,
    or the lowercase hex SHA-256 of both with ``digest``, of the bytes alone with ``digest_decoded``. A null text is empty: no ids, no
    bytes. Null and repeated ids are kept, one row per row. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()
    # dealt by block when written, so that the documents meet the ids of their words without a shuffle
    blocks = cut_dealt(rows.mapInArrow(_blocks(pattern), (
        f"block bigint, n_words bigint, raw binary, sizes binary, ids array<{id_kind}>, numbers binary, lengths binary")), "block")
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    shares = max(1, -(-words // SHARE_WORDS))
    kind = "<u2" if max(read_ranks(ranks_path).values()) < 2**16 else "<u4"
    handed = _coded_words(blocks, shares, ranks_path, kind)
    hashed = digest or digest_decoded
    return blocks.drop("n_words").groupBy("block").cogroup(handed.groupBy("block")).applyInArrow(
        _assemble(ranks_path, shares, kind, digest, hashed),
        f"id {id_kind}, n_tokens bigint, ids {'string' if digest else 'binary'}, decoded {'string' if hashed else 'binary'}")
