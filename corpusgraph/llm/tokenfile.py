"""Files of token ids in a canonical Huffman code.

A token file is a folder with two tables. ``code`` has one row: the code length of every
id (one byte each, 0 for an id that does not occur). ``blocks`` has one row per block of whole
documents, in document order by ``(part, block)``: the documents' ids and lengths,
checkpoints (bits between one every ``STRIDE`` ids and the next, 16-bit), and the
bit stream. The canonical code follows from its lengths: codes of one length are
consecutive in id order, and longer codes come after shorter ones.

Spark writes and commits both tables, so a lost executor's blocks are written again.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.tasks import lean
from corpusgraph.llm.tokens import encoder
from corpusgraph.plans.loops import cut

#: Longest code, ids between checkpoints, and ids in a block (a longer document is a block of its own).
LONGEST = 20
STRIDE = 128
BLOCK_IDS = 1 << 19


def limited_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    packages, leaves_in = np.zeros(0), []
    for _ in range(longest):
        merged = np.concatenate([weight, packages])
        rank = np.argsort(merged, kind="stable")
        leaves_in.append(np.concatenate([[0], np.cumsum(rank < n)]))
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for leaves in reversed(leaves_in):
        own = int(leaves[take])
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


class CanonicalCode:
    """Code and decoding table of a list of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        steps = np.int64(1) << (self.width - self.lengths[order])
        begin = np.cumsum(steps) - steps
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begin >> (self.width - self.lengths[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.symbol[:int(steps.sum())] = np.repeat(order, steps).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit stream, and the bits between one checkpoint and the next."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        starts = ends - sizes
        words = np.zeros(total // 32 + 3, np.uint64)
        at = starts >> 5
        # each code lies in two neighbouring 32-bit words at most
        shifted = self.codes[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
        np.bitwise_or.at(words, at, shifted >> np.uint64(32))
        np.bitwise_or.at(words, at + 1, shifted & np.uint64(0xFFFFFFFF))
        marks = np.append(starts[::STRIDE], total)
        return words.astype(">u4").tobytes()[:-(-total // 8)], np.diff(marks).astype("<u2")

    def decode(self, stream: bytes, count: int, gaps: np.ndarray) -> np.ndarray:
        """The ids. All runs between checkpoints advance together, one id per step, by table look-up."""
        raw = np.frombuffer(stream + b"\0" * 12, np.uint8)
        lanes = len(gaps)
        place = np.zeros(lanes, np.int64)
        np.cumsum(gaps[:-1], out=place[1:])
        out = np.zeros((STRIDE, lanes), np.uint32)
        mask, down = np.int64((1 << self.width) - 1), 32 - self.width
        words = (raw[:-3].astype(np.int64) << 24) | (raw[1:-2].astype(np.int64) << 16) | (raw[2:-1].astype(np.int64) << 8) | raw[3:]
        full = count - (lanes - 1) * STRIDE
        for step in range(STRIDE):
            if step >= full:
                lanes = len(gaps) - 1
                if not lanes:
                    break
            here = place[:lanes]
            window = (words[here >> 3] << (here & 7)) >> down & mask
            found = self.symbol[window]
            out[step, :lanes] = found
            place[:lanes] = here + self.lengths[found]
        return out.T.reshape(-1)[:count]


def _ids(column) -> list[np.ndarray]:
    """Arrays of the ids of each row of ``(n, ids)``, 16 or 32 bits as stored."""
    return [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for n, x in column]


def _pairs(batch):
    return zip(batch.column("n").to_pylist(), (x.as_buffer() for x in batch.column("ids")))


def _writer(lengths: bytes):
    @lean
    def write(batches):
        code = CanonicalCode(np.frombuffer(lengths, np.uint8))
        part, block = TaskContext.get().partitionId(), 0
        docs, sizes, waiting, held = [], [], [], 0

        def flush():
            stream, gaps = code.encode(np.concatenate(waiting).astype(np.int64))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()),
                pa.array([docs], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([gaps.tobytes()], pa.binary()), pa.array([stream], pa.binary())],
                ["part", "block", "n_ids", "docs", "sizes", "gaps", "stream"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("id").type
            for doc, n, ids in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), _ids(_pairs(batch))):
                if docs and held + n > BLOCK_IDS:
                    yield flush()
                    block += 1
                    docs, sizes, waiting, held = [], [], [], 0
                docs.append(doc)
                sizes.append(n)
                waiting.append(ids)
                held += n
        if docs:
            yield flush()
    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, pattern: str, end: int | None = 0, id_column: str = "doc_id",
                 text_column: str = "text", added: bool = False) -> None:
    """Encode every text and write a token file of all documents in ascending id order at ``path``.

    Texts are encoded once, to a table of ids in the checkpoint folder with the counts of each
    task's ids beside them; global counts (at most one row per vocabulary entry comes to the driver) give the code; the
    ids, not the texts, are then sorted by range and packed.

    With ``added`` the added tokens of the tokenizer file are found in the texts and get their own
    ids, as in the library's ``encode``; without, they are spelled (``encode_special_tokens``).

    A null text is empty: only its end id, if any. Null document ids come last; rows that
    tie are ordered by their ids. Other columns are ignored. An empty table gives no blocks.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    encoded = cut(rows.mapInArrow(encoder(tokenizer, pattern, end, added),
                                  f"id {kind}, n bigint, ids binary, tokens array<int>, counts array<bigint>"))
    seen = encoded.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(
        F.sum("x.counts").alias("n")).withColumnRenamed("tokens", "token").collect()
    counts = np.zeros(max((r["token"] for r in seen), default=0) + 1, np.int64)
    counts[[r["token"] for r in seen]] = [r["n"] for r in seen]
    lengths = limited_lengths(counts).tobytes()
    docs.sparkSession.createDataFrame([(bytearray(lengths),)], "lengths binary").write.parquet(f"{path}/code")
    order = [F.col("id").asc_nulls_last(), F.col("ids")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded.filter("n IS NOT NULL").select("id", "n", "ids").repartitionByRange(parts, order[0]).sortWithinPartitions(*order).mapInArrow(
        _writer(lengths), f"part int, block int, n_ids bigint, docs array<{kind}>, sizes array<bigint>, gaps binary, stream binary",
    ).write.parquet(f"{path}/blocks")


def _reader(lengths: bytes, digest: bool):
    @lean
    def read(batches):
        code = CanonicalCode(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                gaps = np.frombuffer(row["gaps"], "<u2").astype(np.int64)
                ids = code.decode(row["stream"], row["n_ids"], gaps) if row["n_ids"] else np.zeros(0, np.uint32)
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                ids = ids.astype("<u4")
                own = [ids[e - n:e].tobytes() for e, n in zip(ends, sizes)]
                n = len(sizes)
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(own, pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                    pa.array(row["docs"], batch.schema.field("docs").type.value_type), pa.array(ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()), last],
                    ["part", "block", "id", "place", "n_tokens", "ids_crc32" if digest else "ids"])
    return read


def read_tokens(spark, path: str, digest: bool = False) -> DataFrame:
    """Documents of a token file: ``id, start, n_tokens`` and ``ids`` (binary), or ``ids_crc32`` with ``digest``.

    Blocks are decoded independently. ``start`` adds up block sizes: per part in one small
    window over the parts, then inside each part.
    """
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    sizes = cut(blocks.select("part", "block", "n_ids"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.join(parts, "part").select(
        "part", "block", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("begin")))
    last = "ids_crc32 bigint" if digest else "ids binary"
    docs = blocks.mapInArrow(_reader(lengths, digest), f"part int, block int, id {kind}, place bigint, n_tokens bigint, {last}")
    return docs.join(starts, ["part", "block"]).select(
        "id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", last.split()[0])
