"""Encoding whole texts with a public tokenizer file."""

import json
import os
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from corpusgraph.llm.chunks import SPLIT_AT_ONCE, PieceTable, gather
from corpusgraph.llm.tasks import lean

#: Pieces that a worker remembers, and rows and bytes (and one row) that it encodes at once.
REMEMBERED = 2_000_000
ROWS = 8192
BYTES = 4_000_000


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)}


class TextEncoder:
    """Ids of texts by the model of the tokenizers library; pieces of text that were seen before are looked up.

    With ``added``, texts that hold an added token of the file go through the library as a whole;
    without, such a token is spelled like other text.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            tokens = json.load(file).get("added_tokens") or [] if added else []
        self.added = "|".join(f"\\Q{x['content']}\\E" for x in tokens)
        self.split = regex.compile(pattern).findall
        self.letters = _byte_letters()
        self._clear()

    def _clear(self):
        self.table = PieceTable()
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self):
        fresh, sizes, ids = self.table.fresh(), [], []
        tokenize, number, last = self.model.tokenize, attrgetter("id"), len(self.ids)
        for low in range(0, len(fresh), SPLIT_AT_ONCE):
            split = list(map(self.split, fresh[low:low + SPLIT_AT_ONCE]))
            words = list(chain.from_iterable(split))
            # 255 is in no UTF-8 text, so all words are spelled at once
            spelled = b"\xff".join(map(str.encode, words)).decode("latin-1").translate(self.letters).split(self.letters[255])
            counts, own = [0], []
            for word in spelled if words else ():
                own.extend(map(number, tokenize(word)))
                counts.append(len(own))
            ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
            sizes.append(last + np.array(counts, np.int64)[ends])
            last += len(own)
            ids.append(np.array(own, np.uint32))
        if fresh:
            self.starts, self.ids = np.concatenate([self.starts, *sizes]), np.concatenate([self.ids, *ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) in order, and the offsets between texts."""
        if len(self.table) > REMEMBERED:
            self._clear()
        held = pc.fill_null(pc.match_substring_regex(texts, self.added), False) if self.added else pa.array([False] * len(texts))
        pieces, offsets = self.table.piece_numbers(pc.if_else(held, "", texts))
        self._learn()
        sizes = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.diff(self.starts)[pieces], out=sizes[1:])
        ids, offsets = gather(pieces, self.starts, self.ids), sizes[offsets]
        rows = np.flatnonzero(np.array(held))
        if not len(rows):
            return ids, offsets
        coded = [np.array(self.whole.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32) for k in rows]
        counts = np.diff(offsets)
        counts[rows] = [len(x) for x in coded]
        return np.insert(ids, np.repeat(offsets[rows], counts[rows]), np.concatenate(coded)), np.append(0, np.cumsum(counts))


@lru_cache(maxsize=2)
def worker_encoder(path: str, pattern: str, added: bool = False) -> TextEncoder:
    """One per Python worker, so that its memory lasts over tasks."""
    return TextEncoder(path, pattern, added)


def encoder(path: str, pattern: str, end: int | None, added: bool = False):
    """Arrow function: ``id, n, ids`` of ``id, text``, ids as little-endian 16-bit numbers (32-bit if one needs it).

    Each task ends with one row without ``n``: the ids that it gave out and how often, in ``tokens`` and ``counts``.
    """
    lists = [pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["id", "n", "ids", "tokens", "counts"]

    @lean
    def run(batches):
        coder, seen, kind = worker_encoder(path, pattern, added), np.zeros(0, np.int64), None
        for batch in batches:
            kind = batch.column("id").type
            ends = np.cumsum(np.array(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
            low = 0
            while low < batch.num_rows:
                stop = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BYTES, "right"))
                part = batch.slice(low, max(1, min(stop - low, ROWS)))
                low += len(part)
                ids, offsets = coder.encode(part.column("text"))
                counts = np.diff(offsets)
                if end is not None:
                    ids = np.insert(ids, offsets[1:], end)
                    counts = counts + 1
                    offsets = offsets + np.arange(len(offsets))
                now = np.bincount(ids, minlength=len(seen))
                now[:len(seen)] += seen
                seen = now
                small = bool(len(ids)) and int(ids.max()) > 65_535
                width = np.dtype("<u4" if small else "<u2")
                binary = pa.Array.from_buffers(pa.large_binary(), len(part), [
                    None, pa.py_buffer((offsets * width.itemsize).astype(np.int64)), pa.py_buffer(ids.astype(width))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts, pa.int64()), binary.cast(pa.binary()), *(pa.nulls(len(part), x) for x in lists)], names)
        used = np.flatnonzero(seen)
        if len(used):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([used], lists[0]), pa.array([seen[used]], lists[1])], names)
    return run
