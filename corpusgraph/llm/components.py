"""Connected components of link tables of any size."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.tasks import lean
from corpusgraph.plans.loops import RoundLimit, cut, cut_counting

#: Leaf rows that one task's union-find holds at most when stars are contracted again.
STARS_PER_TASK = 1_000_000


class UnionFind:
    """Sets of nodes; the smallest node of a set is its root."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


@lean
def _contract(batches):
    """Links of one task to a star per set of nodes that they join; at most nodes - 1 rows leave."""
    sets, schema = UnionFind(), None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
    if schema is not None:
        nodes = [x for x in sets.parent if sets.find(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, schema.types[0]), pa.array([sets.find(x) for x in part], schema.types[1])],
                                             schema=schema)


def _with_least(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(id, component)`` of every node in ``links (a, b)`` but the smallest of each component, which names it.

    Tasks first contract their own links to stars, then as few tasks as can hold the
    stars (``STARS_PER_TASK`` each) contract again. Where more than one task is needed, the
    two alternating star steps (every neighbour to the smallest one, first the larger
    neighbours, then the smaller) follow until no centre is a leaf, about log(n)
    rounds. A hub's rows are joined with one smallest value, so a split join serves it.
    Null ends are dropped; a node linked only with itself has no row.
    """
    links = links.select("a", "b").filter("a <> b")
    kinds = [f.dataType.simpleString() for f in links.schema.fields]
    schema = f"u {kinds[0]}, v {kinds[1]}"
    stars, counts = cut_counting(links.mapInArrow(_contract, schema))
    tasks = -(-counts["rows"] // STARS_PER_TASK)
    if tasks:
        stars, counts = cut_counting(stars.coalesce(tasks).mapInArrow(_contract, schema))
    for _ in range(max_rounds if tasks > 1 else 0):
        leaves = stars.groupBy("u").agg(F.count("*").alias("n"))
        open_ends = stars.select(F.col("v").alias("u")).distinct().join(leaves, "u", "left_semi").select("u")
        if not open_ends.unionByName(leaves.filter("n > 1").select("u")).limit(1).count():
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _with_least(large)
        stars = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    else:
        if tasks > 1:
            raise RoundLimit(f"components still changing after {max_rounds} rounds")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
