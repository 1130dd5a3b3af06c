"""Graph jobs on literal graphs and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import graph as G
from corpusgraph.operators import hierarchy as H
from corpusgraph.operators import scenes as N
from corpusgraph.plans.loops import closure, jump_to_end


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "import") for a, b in pairs], "src string, dst string, kind string")


def nodes_of(spark, ids, kind="module"):
    return spark.createDataFrame([(i, kind, "js") for i in ids], "id string, type string, engine string")


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def reach(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in pairs:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def random_pairs(seed, n=14, m=22):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize("seed", [2])
def test_closure_and_cycles_match_brute_force(spark, seed):
    pairs = random_pairs(seed)
    ids = sorted({x for p in pairs for x in p})
    edges = edges_of(spark, pairs)
    want = sorted((s, i) for s in ids for i in reach(pairs, s))
    assert rows(G.reachable(nodes_of(spark, ids).select("id"), edges)) == want
    # The same with every node treated as a hub whose links are split.
    seeds = nodes_of(spark, ids).select(F.col("id").alias("seed"), "id")
    assert rows(closure(seeds, edges, ["seed"], hub_limit=1).select("seed", "id")) == want
    both = {(a, b) for a, b in want}
    groups = {}
    for i in ids:
        mates = {j for j in ids if (i, j) in both and (j, i) in both}
        if len(mates) > 1 or (i, i) in set(pairs):
            groups[i] = min(mates)
    assert dict(rows(G.cycle_groups(edges))) == groups


def test_long_cycle_and_chain_take_few_rounds(spark):
    ring = [(f"c{i:04d}", f"c{(i + 1) % 120:04d}") for i in range(120)]
    got = rows(G.cycle_groups(edges_of(spark, ring)))
    assert len(got) == 120 and {c for _, c in got} == {"c0000"}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(500)], "id long, parent long")
    ends = jump_to_end(chain)
    assert ends.filter("root = 0 AND steps = id AND NOT cyclic").count() == 500


def test_run_in_an_acyclic_part_is_no_cycle(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "f")]
    assert rows(G.cycle_groups(edges_of(spark, pairs))) == [("a", "a"), ("b", "a"), ("f", "f"), ("g", "f")]


def test_layers_and_orphans(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("d", "gone")]
    nodes = nodes_of(spark, list("abcdxyz")).unionByName(nodes_of(spark, ["t.png"], "asset"))
    edges = edges_of(spark, pairs)
    placed = dict(rows(G.layers(nodes, edges).select("id", F.coalesce("layer", F.lit(-1)).alias("layer"))))
    assert placed == {"d": 0, "c": 1, "b": 2, "a": 3, "t.png": 0, "x": -1, "y": -1, "z": -1}
    assert dict(rows(G.orphans(nodes, edges))) == {"a": "entry_point", "z": "entry_point", "t.png": "unreferenced_asset"}
    assert rows(G.dangling(nodes, edges)) == [("d", "gone", "import")]


def test_star_neighbourhood(spark):
    edges = edges_of(spark, [(f"n{i}", "n0") for i in range(1, 200)])
    nodes = nodes_of(spark, [f"n{i}" for i in range(200)])
    focus = nodes.filter("id = 'n1'").select("id")
    near = G.neighbourhood(nodes, edges, focus, 2)
    assert near.groupBy("distance").count().orderBy("distance").collect() == [(0, 1), (1, 1), (2, 198)]
    assert G.neighbourhood(nodes, edges, spark.createDataFrame([("no",)], "id string"), 1).count() == 0


def test_fingerprint_ignores_order(spark):
    nodes, pairs = nodes_of(spark, list("abc")), [("a", "b"), ("b", "c")]
    one = G.fingerprint(nodes, edges_of(spark, pairs)).collect()
    assert one == G.fingerprint(nodes.repartition(3), edges_of(spark, pairs[::-1])).collect()
    assert one != G.fingerprint(nodes, edges_of(spark, pairs[:1])).collect()


def test_tree_opens_cycles_at_the_first_member(spark):
    data = [(1, None), (2, 1), (3, 3), (4, 99), (5, 7), (6, 5), (7, 6), (8, 7)]
    tree = H.build_tree(spark.createDataFrame(data, "id long, parent long"))
    got = {r.id: (r.root, r.depth, r.orphan) for r in tree.collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (3, 0, True), 4: (4, 0, True),
                   5: (5, 0, True), 6: (5, 1, False), 7: (5, 2, False), 8: (5, 3, False)}
    order = [r.id for r in H.flatten(tree).orderBy("order_key").collect()]
    assert order == [1, 2, 3, 4, 5, 6, 7, 8]


def test_removals_in_a_row(spark):
    data = [("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("d", "r")]
    frame = spark.createDataFrame(data, "id string, parent string")
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert rows(N.remove_instances(frame, gone("a", "b")).fillna("-")) == [("c", "r"), ("d", "r"), ("r", "-")]
    assert rows(N.remove_instances(frame, gone("r", "a")).fillna("-")) == [("b", "r"), ("c", "b"), ("d", "r")]
