"""Line diffs of version pairs ``(key, before, after)``."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import text as T
from corpusgraph.functions.exprs import let

_OP = "struct<type:string,line:string,before_line:int,after_line:int>"


#: A line with more places in the new text keeps their bits as one number; others set them when they are met.
FREQUENT = 64


class _Rows:
    """Rows of the common-subsequence table, one bit per line of ``after``.

    Row i holds the common lengths of ``before[i:]`` and every ``after[j:]``, as the bits in which neighbours do
    not differ: the length at j is the count of 0 bits among the lowest ``m - j``. A row follows from the one
    below by one addition over all bits. Every ``stripe``-th row is kept and the rows of a
    stripe are made again on the way through it, so memory grows with sqrt(n) * m / 8 bytes.
    """

    def __init__(self, before: list, after: list):
        self.before, self.n, self.m = before, len(before), len(after)
        self.places: dict = {}
        for k, line in enumerate(reversed(after)):
            self.places.setdefault(line, []).append(k)
        self.dense = {line: self._bits(at) for line, at in self.places.items() if len(at) > FREQUENT}
        self.all = (1 << self.m) - 1
        self.stripe = max(1, math.isqrt(self.n))
        row, self.kept, self.near = self.all, {}, {}
        for i in range(self.n, -1, -1):
            row = row if i == self.n else self._above(i, row)
            if i % self.stripe == 0 or i == self.n:
                self.kept[i] = row

    def _bits(self, places: list[int]) -> int:
        raw = bytearray((self.m + 7) // 8)
        for k in places:
            raw[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(raw, "little")

    def _above(self, i: int, row: int) -> int:
        places = self.places.get(self.before[i])
        if places is None:
            return row
        met = row & (self.dense.get(self.before[i]) or self._bits(places))
        return ((row + met) | (row - met)) & self.all

    def row(self, i: int) -> tuple[int, bytes]:
        """Row i as a number and as bytes, for ``i`` that grows."""
        if i not in self.near:
            last = min(self.n, (i // self.stripe + 1) * self.stripe)
            row = self.kept[last]
            made = {last: row}
            for k in range(last - 1, i - 1, -1):
                made[k] = row = self._above(k, row)
            self.near = {k: (row, row.to_bytes((self.m + 7) // 8, "little")) for k, row in made.items()}
        return self.near[i]

    def length(self, i: int, j: int) -> int:
        """Common lines of ``before[i:]`` and ``after[j:]``."""
        rest = self.m - j
        return rest - (self.row(i)[0] & ((1 << rest) - 1)).bit_count()


def _walk(before: list, after: list) -> list[tuple]:
    """Operations of the longest common subsequence walk; a tie deletes first. Files of any length have a diff."""
    table = _Rows(before, after)
    n, m, ops, i, j = len(before), len(after), [], 0, 0
    while i < n and j < m:
        here, below = table.length(i, j), table.length(i + 1, j)
        own, under = table.row(i)[1], table.row(i + 1)[1]
        while j < m and before[i] != after[j]:
            at = m - 1 - j
            here -= 1 - (own[at >> 3] >> (at & 7) & 1)  # the length one line on
            if below >= here:
                break
            below -= 1 - (under[at >> 3] >> (at & 7) & 1)
            ops.append(("add", after[j], None, j + 1))
            j += 1
        if j == m:
            break
        if before[i] == after[j]:
            ops.append(("context", before[i], i + 1, j + 1))
            j += 1
        else:
            ops.append(("delete", before[i], i + 1, None))
        i += 1
    ops += [("delete", before[k], k + 1, None) for k in range(i, n)]
    ops += [("add", after[k], None, k + 1) for k in range(j, m)]
    return ops


#: Pairs of texts whose lines are Python objects at once.
SLICE = 64
_ARROW = pa.struct([("type", pa.string()), ("line", pa.string()), ("before_line", pa.int32()), ("after_line", pa.int32())])


def _operations(before: pa.Array, after: pa.Array) -> pa.Array:
    """The walks of a batch, made a slice at a time, so that a worker holds the batch and its answer as Arrow and few lines more."""
    done = [pa.array([], pa.list_(_ARROW))]
    for low in range(0, len(before), SLICE):
        walks = [_walk(x, y) for x, y in zip(before.slice(low, SLICE).to_pylist(), after.slice(low, SLICE).to_pylist())]
        columns = [pa.array([op[k] for ops in walks for op in ops], field.type) for k, field in enumerate(_ARROW)]
        ends = np.cumsum([0, *map(len, walks)]).astype(np.int32)
        done.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_ARROW))))
    return pa.concat_arrays(done)


def diff_operations(before: Column, after: Column):
    """The walk and its input: both line lists and the length of their common head.

    The common head is cut off natively; equal first lines always pair, so this is
    exact. A common tail may pair differently and is left to the table.
    """
    # Marked so that the planner runs it once and does not copy it into filters.
    walk = F.arrow_udf(_operations, f"array<{_OP}>").asNondeterministic()
    lines = F.struct(T.diff_lines(before).alias("b"), T.diff_lines(after).alias("a"))

    def cut(l: Column) -> Column:
        shared = F.least(F.size(l["b"]), F.size(l["a"]))
        differs = F.filter(F.sequence(F.lit(0), shared), lambda i: ~F.get(l["b"], i).eqNullSafe(F.get(l["a"], i)) | (i == shared))
        return F.struct(l["b"].alias("b"), l["a"].alias("a"), F.get(differs, F.lit(0)).alias("head"))

    return walk, let(lines, cut)


def line_diff(versions: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``refused`` and ``ops`` to version pairs.

    Files of any length are compared; a caller who sets ``limit`` refuses longer ones.
    """
    walk, cut = diff_operations(F.col("before"), F.col("after"))
    rows = versions.withColumn("_c", cut)
    longest = F.greatest(F.size("_c.b"), F.size("_c.a"))
    rows = rows.withColumn("refused", F.lit(False) if limit is None else longest > limit)
    empty = F.array().cast("array<string>")
    tail = lambda side: F.when(F.col("refused"), empty).otherwise(F.slice(f"_c.{side}", F.col("_c.head") + 1, F.size(f"_c.{side}")))
    rows = rows.withColumn("_t", walk(tail("b"), tail("a")))
    head = F.transform(F.slice("_c.b", F.lit(1), F.col("_c.head")), lambda s, i: F.struct(
        F.lit("context").alias("type"), s.alias("line"), (i + 1).alias("before_line"), (i + 1).alias("after_line")))
    shifted = F.transform("_t", lambda o: F.struct(
        o["type"].alias("type"), o["line"].alias("line"), (o["before_line"] + F.col("_c.head")).alias("before_line"),
        (o["after_line"] + F.col("_c.head")).alias("after_line")))
    ops = F.when(~F.col("refused"), F.concat(head.cast(f"array<{_OP}>"), shifted.cast(f"array<{_OP}>")))
    return rows.withColumn("ops", ops).drop("_c", "_t")


def operation_rows(diffed: DataFrame, key: str) -> DataFrame:
    rows = diffed.select(key, F.posexplode("ops").alias("i", "o"))
    return rows.select(key, (F.col("i") + 1).alias("op_no"), "o.type", "o.line", "o.before_line", "o.after_line")


def hunks(ops: Column, context: int = K.DIFF_CONTEXT_LINES) -> Column:
    """``array<struct(start, end)>`` of 0-based operation ranges around changes."""
    changed = F.filter(F.transform(ops, lambda o, i: F.when(o["type"] != "context", i)), lambda i: i.isNotNull())

    def merge(acc: Column, at: Column) -> Column:
        low = F.greatest(F.lit(0), at - context)
        high = F.least(F.size(ops) - 1, at + context)
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], high).alias("end"))))
        fresh = F.concat(acc, F.array(F.struct(low.alias("start"), high.alias("end"))))
        return F.when(F.size(acc) == 0, fresh).when(low <= last["end"] + 1, grown).otherwise(fresh)

    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(changed, F.array().cast(kind), lambda acc, at: merge(acc, at).cast(kind))


def _hunk_parts(ops: Column, hunk: Column) -> Column:
    rows = F.slice(ops, hunk["start"] + 1, hunk["end"] - hunk["start"] + 1)
    n_before = F.size(F.filter(rows, lambda r: r["type"] != "add"))
    n_after = F.size(F.filter(rows, lambda r: r["type"] != "delete"))
    first = lambda name: F.coalesce(F.get(F.filter(F.transform(rows, lambda r: r[name]), lambda v: v.isNotNull()), F.lit(0)), F.lit(0))
    return F.struct(
        F.when(n_before == 0, 0).otherwise(first("before_line")).alias("before_start"), n_before.alias("before_count"),
        F.when(n_after == 0, 0).otherwise(first("after_line")).alias("after_start"), n_after.alias("after_count"),
        F.transform(rows, lambda r: F.concat(
            F.when(r["type"] == "add", "+").when(r["type"] == "delete", "-").otherwise(" "), r["line"])).alias("lines"))


def hunk_rows(diffed: DataFrame, key: str) -> DataFrame:
    parts = F.transform(hunks(F.col("ops")), lambda h: _hunk_parts(F.col("ops"), h))
    rows = diffed.select(key, F.posexplode(parts).alias("i", "h"))
    return rows.select(key, (F.col("i") + 1).alias("hunk_no"), "h.before_start", "h.before_count", "h.after_start",
                       "h.after_count", F.array_join("h.lines", "\n").alias("body"))


def render(diffed: DataFrame, path: Column) -> DataFrame:
    """Add ``diff``: the unified text, empty when nothing changed."""
    parts = F.transform(hunks(F.col("ops")), lambda h: _hunk_parts(F.col("ops"), h))
    number = lambda v: v.cast("string")
    texts = F.transform(parts, lambda h: F.concat(
        F.lit("@@ -"), number(h["before_start"]), F.lit(","), number(h["before_count"]), F.lit(" +"), number(h["after_start"]),
        F.lit(","), number(h["after_count"]), F.lit(" @@\n"), F.array_join(h["lines"], "\n")))
    old = F.when(F.col("before") == "", "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), path))
    new = F.when(F.col("after") == "", "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), path))
    text = F.concat(old, F.lit("\n"), new, F.lit("\n"), F.array_join(texts, "\n"), F.lit("\n"))
    return diffed.withColumn("diff", F.when(F.size(texts) == 0, "").otherwise(text))


def multiset_diff(versions: DataFrame, key: str) -> DataFrame:
    """``(key, added, removed)`` lines with multiplicity.

    Both sides are counted together, so equal lines cancel in partial sums.
    """
    lines = lambda side, weight: versions.select(key, F.explode(T.diff_lines(F.col(side))).alias("line"), F.lit(weight).alias("w"))
    net = lines("after", 1).unionByName(lines("before", -1)).groupBy(key, "line").agg(F.sum("w").alias("w"))
    changed = net.groupBy(key).agg(F.sum(F.greatest("w", F.lit(0))).alias("added"),
                                   F.sum(F.greatest(-F.col("w"), F.lit(0))).alias("removed"))
    return changed.filter("added > 0 OR removed > 0")


def changed_files(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, before, after)`` where the content differs; NULL means absent."""
    joined = before.withColumnRenamed("content", "before").join(after.withColumnRenamed("content", "after"), keys, "full")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, "before", "after")
