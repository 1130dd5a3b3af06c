"""Ranked lexical search: many queries over all documents, sharing what they have in common.

The terms of a block of items are looked up once in every text; what stays is one narrow row
per document: its length and the counts of those terms. Term sets that several items
share are mined as a graph of sums: terms in exactly the same items become one set, then the pair of
sets that most items share becomes a set of its own, again and again. A batch of documents
adds up each shared set once, and an item is the sum of a few sets.
"""

import math
from collections import Counter, defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm import wordhash
from corpusgraph.llm.contamination import WORD, _FOLD
from corpusgraph.llm.order import with_running_sum
from corpusgraph.llm.tasks import lean
from corpusgraph.plans.loops import cut, cut_counting

#: (item, term) pairs of a block of items; an item with more is a block of its own. Each block is one pass over the documents.
BLOCK_TERMS = 50_000
#: Sets of an item among which pairs are mined, the most shared first; the others are added to the item one by one.
MINED = 64
#: Accumulators (sets times documents) that a task holds at once.
CELLS = 2_000_000
TOP = 10


def shared_sums(items: list[list[int]], mined: int = MINED) -> tuple[list[list[int]], list[list[int]]]:
    """Sums over terms that several items share: ``(sums, items)``.

    ``items`` lists distinct terms (numbers below T) per item. Node T + k is the sum of the nodes
    ``sums[k]``, all of lower number; an item is the sum of the nodes listed for it. Every
    term of an item is reached exactly once.
    """
    holders = defaultdict(list)
    for i, terms in enumerate(items):
        for term in terms:
            holders[term].append(i)
    alike = defaultdict(list)
    for term, held in sorted(holders.items()):
        alike[tuple(held)].append(term)
    base = max(holders, default=-1) + 1
    sums, of = [], [set() for _ in items]

    def add(nodes: list[int]) -> int:
        sums.append(nodes)
        return base + len(sums) - 1

    weight = {}
    for held, terms in alike.items():
        node = terms[0] if len(terms) == 1 else add(terms)
        weight[node] = len(held)
        for i in held:
            of[i].add(node)
    inside = []
    for nodes in of:
        inside.append(set(sorted(nodes, key=lambda x: (-weight[x], x))[:mined]))
    counts, where = Counter(), defaultdict(set)
    for i, nodes in enumerate(inside):
        for node in nodes:
            where[node].add(i)
        ordered = sorted(nodes)
        counts.update((a, b) for k, a in enumerate(ordered) for b in ordered[k + 1:])
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapify(heap)
    while heap:
        n, (a, b) = heappop(heap)
        both = where[a] & where[b]
        if len(both) < 2:
            continue
        if len(both) != -n:  # others took some of its items meanwhile
            heappush(heap, (-len(both), (a, b)))
            continue
        node = add([a, b])
        near = Counter()
        for i in both:
            inside[i] -= {a, b}
            of[i] -= {a, b}
            near.update(inside[i])
            inside[i].add(node)
            of[i].add(node)
        where[a] -= both
        where[b] -= both
        where[node] = set(both)
        for other, m in near.items():
            if m > 1:
                heappush(heap, (-m, (other, node)))
    return sums, [sorted(x) for x in of]


def _terms(texts: list[str | None]) -> list[list[str]]:
    return [sorted(set(WORD.findall((t or "").translate(_FOLD)))) for t in texts]


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, terms)`` of ``items (id, text)``: distinct terms in order; rows of one id are one item."""
    kind = items.schema[0].dataType.simpleString()

    @lean
    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_terms(batch.column(1).to_pylist()), pa.list_(pa.string()))],
                                             ["item", "terms"])

    id_, text = items.columns[:2]
    rows = items.select(F.col(id_).alias("item"), F.col(text).alias("text")).mapInArrow(split, f"item {kind}, terms array<string>")
    return rows.groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def _hashes(terms: list[str]) -> np.ndarray:
    raw, ends = wordhash.text_bytes(pa.array(terms, pa.string()))
    return wordhash.span_hashes(raw, ends[:-1], ends[1:])


def _counter(hashes: np.ndarray):
    """Arrow function: per text with a term ``id, n, terms, counts``, and per task one row of sums.

    That row has ``stats`` set: the documents and terms of the task and in how many documents each
    searched term is. Terms are numbers in the order of the sorted ``hashes``.
    """
    @lean
    def count(batches):
        docs = words = 0
        frequency = np.zeros(len(hashes), np.int64)
        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for at, to, raw, ends in wordhash.chunks(batch.column("text")):
                begin, end = wordhash.word_spans(raw, ends, wordhash.SIGNS)
                firsts = np.searchsorted(begin, ends)
                value = wordhash.span_hashes(raw, begin, end)
                place = np.minimum(np.searchsorted(hashes, value), max(len(hashes) - 1, 0))
                met = np.flatnonzero(hashes[place] == value) if len(hashes) else np.zeros(0, np.int64)
                owner = np.searchsorted(firsts, met, "right") - 1
                pair, times = np.unique(owner * max(len(hashes), 1) + place[met], return_counts=True)
                owner, term = pair // max(len(hashes), 1), pair % max(len(hashes), 1)
                frequency += np.bincount(term, minlength=len(hashes))[:len(hashes)]
                n = np.diff(firsts)
                docs, words = docs + int((n > 0).sum()), words + int(n.sum())
                some = np.flatnonzero(np.bincount(owner, minlength=to - at) > 0)
                starts = pa.array(np.searchsorted(owner, np.append(some, to - at)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, to - at).take(pa.array(some)), pa.array(n[some]),
                    pa.ListArray.from_arrays(starts, pa.array(term, pa.int32())), pa.ListArray.from_arrays(starts, pa.array(times, pa.int64())),
                    pa.nulls(len(some), pa.list_(pa.int64()))], ["id", "n", "terms", "counts", "stats"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, kind), pa.array([words]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())),
                pa.array([[docs, *frequency.tolist()]], pa.list_(pa.int64()))], ["id", "n", "terms", "counts", "stats"])
    return count


def _best(table: pa.Table, top: int) -> pa.Table:
    """The ``top`` rows of each item: highest score, then smallest id, null last."""
    order = pc.sort_indices(table, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
    table = table.take(order)
    item = table.column("item").to_numpy()
    first = np.searchsorted(item, item, "left")
    return table.filter(pa.array(np.arange(len(item)) - first < top))


def _scorer(weights: np.ndarray, sums: list[list[int]], items: list[list[int]], documents: int, words: int, top: int):
    """Arrow function: the best documents of each item in a task as ``item`` (number), ``id``, ``score``."""
    terms = len(weights)
    step = max(16, CELLS // max(terms + len(sums), 1))
    used = [np.array(x, np.int64) for x in items]

    @lean
    def score(batches):
        best, floor = None, np.zeros(len(items), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n, lists, times = part.column("n").to_numpy(), part.column("terms"), part.column("counts").flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), np.diff(np.array(lists.offsets)))
                term = lists.flatten().to_numpy()
                middle = 10 + (90 * n * documents) // max(words, 1)
                acc = np.zeros((terms + len(sums), len(n)), np.int64)
                acc[term, owner] = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * middle[owner]))
                for k, nodes in enumerate(sums):
                    np.sum(acc[nodes], axis=0, out=acc[terms + k])
                found_item, found_row, found_score = [], [], []
                for i, nodes in enumerate(used):
                    total = acc[nodes].sum(axis=0)
                    rows = np.flatnonzero(total >= max(floor[i], 1))
                    found_item.append(np.full(len(rows), i, np.int32))
                    found_row.append(rows)
                    found_score.append(total[rows])
                fresh = pa.table([pa.array(np.concatenate(found_item)), part.column("id").take(pa.array(np.concatenate(found_row))),
                                  pa.array(np.concatenate(found_score))], ["item", "id", "score"])
                best = _best(fresh if best is None else pa.concat_tables([best, fresh]), top)
                item, points = best.column("item").to_numpy(), best.column("score").to_numpy()
                full = np.flatnonzero(np.bincount(item, minlength=len(items)) == top)
                floor[full] = points[np.searchsorted(item, full, "right") - 1]
        if best is not None:
            yield from best.combine_chunks().to_batches()
    return score


def _search_block(block: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """The best documents of the items of one block: ``number, id, score``; and the items ``number, item``."""
    spark = docs.sparkSession
    held = block.orderBy("item").toArrow()
    lists = held.column("terms").to_pylist()
    names = sorted({t for x in lists for t in x})
    hashes = _hashes(names)
    order = np.argsort(hashes, kind="stable")
    place = {names[k]: n for n, k in enumerate(order)}
    hashes, kind = hashes[order], docs.schema["id"].dataType.simpleString()
    counted = cut(docs.mapInArrow(_counter(hashes), f"id {kind}, n long, terms array<int>, counts array<long>, stats array<long>"))
    stats = counted.filter("stats IS NOT NULL")
    words = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    sums = {r["pos"]: r["n"] for r in stats.select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    documents = sums.get(0, 0)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * sums.get(k + 1, 0) + 1))) for k in range(len(hashes))], np.int64)
    shared, used = shared_sums([[place[t] for t in x] for x in lists])
    found = counted.filter("stats IS NULL").select("id", "n", "terms", "counts").mapInArrow(
        _scorer(weights, shared, used, documents, words, top), f"item int, id {kind}, score long")
    numbered = pa.table([pa.array(np.arange(len(lists)), pa.int32()), held.column("item")], ["number", "item"])
    named = spark.createDataFrame(numbered)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= top).withColumnRenamed("item", "number")
    return ranked.join(named, "number").select("item", "rank", F.col("id").alias("doc"), "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item, rank, doc, score)``: the ``top`` documents of each item with a score above 0.

    ``docs (id, text)`` and ``items (id, text)``: the first two columns count, whatever their names. Terms
    are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. N documents have a term, L terms
    are in all; a term in ``df`` documents weighs ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document of n terms
    has ``m = 10 + 90 n N div L`` and gives ``w * (10^9 tf div (1000 tf + 8 m))`` for each distinct term of the item.
    Equal scores are in order of the document's id, null last; equal document rows are ranked one after another.
    Null, empty and wordless texts are in no result; such items have none. Rows of one item id,
    null too, are one item. Terms are told apart by 64-bit hashes.
    """
    id_, text = docs.columns[:2]
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    known, _ = cut_counting(item_terms(items))
    total = known.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    if total <= block_terms:
        return _search_block(known, rows, top)
    placed = cut(with_running_sum(known, [F.col("item")], F.size("terms").cast("long"), "before").withColumn(
        "block", F.floor(F.col("before") / block_terms)))
    result = None
    for number in [x["block"] for x in placed.select("block").distinct().orderBy("block").collect()]:
        part = cut(_search_block(placed.filter(F.col("block") == number).drop("block", "before"), rows, top))
        result = part if result is None else result.unionByName(part)
    return result
