"""Graphs of several projects that share ids, solved in tasks and in loops, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import graph as G
from corpusgraph.plans.dense import dictionary
from corpusgraph.plans.reach import reach_pairs

LIMITS = [0, 40, 10**9]  # all in loops, some, all in tasks


def sample(seed=4):
    rng = random.Random(seed)
    nodes, edges = [], []
    for project in (1, 2, 30):
        ids = [f"n{k}" for k in range(12)] + ["é", "z"]
        nodes += [(project, i, rng.choice(["module", "asset"])) for i in ids[:-1]]
        edges += [(project, rng.choice(ids), rng.choice(ids), "import") for _ in range(10 + project)]
    edges += [(1, "gone", "n1", "import"), (1, "n2", "lost", "import"), (1, None, "n1", "import"), (None, "n1", "n2", "import"), edges[0]]
    nodes += [(7, "alone", "module"), (7, "asset.png", "asset")]
    return nodes, edges


def frames(spark, nodes, edges):
    return (spark.createDataFrame(nodes, "project long, id string, type string"),
            spark.createDataFrame(edges, "project long, src string, dst string, kind string"))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def graphs(nodes, edges):
    for p in sorted({n[0] for n in nodes}):
        yield p, {n[1]: n[2] for n in nodes if n[0] == p}, {(e[1], e[2]) for e in edges if e[0] == p and None not in e}


def reach(links, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in links:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("limit", LIMITS)
def test_closures_stay_in_their_project(spark, limit):
    nodes, edges = sample()
    n, e = frames(spark, nodes, edges)
    seeds = n.select("project", "id")
    want = [(p, s, x) for p, ids, links in graphs(nodes, edges) for s in ids for x in reach(links, s)]
    assert rows(G.reachable(seeds, e, limit=limit).select("project", "seed", "id")) == sorted(want, key=str)
    want = []
    for p, ids, links in graphs(nodes, edges):
        back = {(b, a) for a, b in links if b in ids}
        want += [(p, s, x) for s in ids for x in reach(back, s) - {s}]
    assert rows(G.transitive_dependents(seeds, n, e, limit=limit).select("project", "seed", "id")) == sorted(want, key=str)


@pytest.mark.parametrize("limit", LIMITS)
def test_neighbourhoods_orphans_and_groups(spark, limit):
    nodes, edges = sample(9)
    n, e = frames(spark, nodes, edges)
    near, orphans, groups, placed = [], [], [], []
    for p, ids, links in graphs(nodes, edges):
        both = {(a, b) for a, b in links | {(b, a) for a, b in links} if a in ids and b in ids}
        for f in ids:
            known = {f: 0}
            for hop in (1, 2):
                known |= {b: hop for a, b in both if known.get(a) == hop - 1 and b not in known}
            near += [(p, f, i, d) for i, d in known.items()]
        real = {(a, b) for a, b in links if a != b and a in ids}
        roots = set(ids) - {b for _, b in real}
        hit = {x for r in roots for x in reach(real, r)} - {r for r in roots}
        needs = {a for a, _ in links}
        orphans += [(p, i, "entry_point" if i in needs else "unreferenced_asset" if t == "asset" else "unreferenced")
                    for i, t in ids.items() if i not in hit]
        every = {x for link in links for x in link}
        far = {x: reach(links, x) for x in every}
        for x in every:
            mates = {y for y in far[x] if x in far[y]}
            if len(mates) > 1 or (x, x) in links:
                groups.append((p, x, min(mates)))
        inside = {(a, b) for a, b in links if a in ids and b in ids}
        layer = {}
        for _ in ids:
            layer |= {i: max([layer[b] + 1 for a, b in inside if a == i], default=0) for i in ids
                      if i not in layer and all(b in layer for a, b in inside if a == i)}
        placed += [(p, i, layer.get(i)) for i in ids]
    got = G.neighbourhood(n.select("project", "id"), e, n.select("project", "id"), 2, limit=limit).select("project", "focus", "id", "distance")
    assert rows(got) == sorted(near, key=str)
    assert rows(G.orphans(n, e, limit=limit).select("project", "id", "reason")) == sorted(orphans, key=str)
    assert rows(G.cycle_groups(e.filter("project IS NOT NULL"), limit=limit).select("project", "id", "cycle")) == sorted(groups, key=str)
    assert rows(G.layers(n, e, limit=limit).select("project", "id", "layer")) == sorted(placed, key=str)


def test_counts_per_project(spark):
    nodes = [(1, "a", "module"), (1, "b", "module"), (2, "a", "asset")]
    edges = [(1, "a", "b", "import"), (2, "a", "b", "import")]
    n, e = frames(spark, nodes, edges)
    got = rows(G.section_counts(n, e))
    assert got == sorted([(1, "nodes", 2), (2, "nodes", 1), (1, "edges", 1), (2, "edges", 1), (1, "layers", 2), (2, "layers", 1),
                          (2, "dangling", 1), (1, "layer 0", 1), (1, "layer 1", 1), (2, "layer 0", 1)], key=str)
    assert (2, "orphans", "", 1) in rows(G.summary(n, e))
    with pytest.raises(ValueError):
        G.layers(n, e.drop("project"))


def test_two_projects_make_no_common_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b", "k"), (2, "b", "a", "k")], "project long, src string, dst string, kind string")
    for limit in LIMITS:
        assert G.cycle_groups(edges, limit=limit).count() == 0


def test_dictionary_follows_the_order(spark):
    names = [(p, f"n{k}") for p in range(5) for k in range(40)] * 2
    got = rows(dictionary(spark.createDataFrame(names, "project long, id string").repartition(6)))
    assert sorted(x[2] for x in got) == list(range(200))
    assert [x[:2] for x in sorted(got, key=lambda x: x[2])] == sorted(set(names))
    assert dictionary(spark.createDataFrame([], "id string")).collect() == []


@pytest.mark.parametrize("hub_limit", [1, 10**6])
def test_words_of_seeds_hold_more_than_one_word(spark, hub_limit):
    chain = [(k, k + 1) for k in range(30)] + [(0, k) for k in range(100, 190)]
    links = spark.createDataFrame(chain, "src long, dst long")
    seeds = spark.createDataFrame([(k,) for k in [*range(31), *range(100, 190)]], "id long")
    got = rows(reach_pairs(seeds, links, hub_limit=hub_limit))
    assert got == sorted(((s, x) for s in [*range(31), *range(100, 190)] for x in reach(chain, s)), key=str)


def ladder_of_cycles(count, size):
    """Cycles of ``size`` nodes, each linked to the next one."""
    links = []
    for c in range(count):
        links += [(c * size + k, c * size + (k + 1) % size) for k in range(size)]
        if c:
            links.append((c * size - 1, c * size))
    return links


@pytest.mark.parametrize("local", [0, 10**6])
def test_cycles_on_a_chain_and_a_long_cycle(spark, local):
    count, size = (6, 4) if local == 0 else (99, 20)
    links = spark.createDataFrame(ladder_of_cycles(count, size), "src long, dst long")
    assert rows(G.loop_cycle_groups(links, local)) == sorted(((k, k // size * size) for k in range(count * size)), key=str)
    ring = spark.range(10_000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 10_000).alias("dst"))
    assert G.loop_cycle_groups(ring, local).filter("cycle = 0").count() == 10_000


def test_layers_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from corpusgraph.plans import loops
    made = []
    cut = loops.cut_counting
    monkeypatch.setattr(G, "cut_counting", lambda *a, **k: made.append(1) or cut(*a, **k))
    monkeypatch.setattr(loops, "cut_counting", lambda *a, **k: made.append(1) or cut(*a, **k))
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")).filter("dst >= 0")
    branches = spark.range(10_000).select((F.col("id") + 20_000).alias("src"), F.col("id").alias("dst"))
    placed = G.loop_layers(spark.range(30_000), chain.unionByName(branches), 0)
    assert placed.filter("(id < 10000 AND layer = id) OR (id >= 20000 AND layer = id - 19999) OR (id BETWEEN 10000 AND 19999 AND layer = 0)").count() == 30_000
    assert len(made) < 25


@pytest.mark.parametrize("local", [0, 6, 10**6])
def test_loop_layers_equal_peeling(spark, local):
    rng = random.Random(17)
    for n, m in ((30, 45), (24, 40)):
        links = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a > b or rng.random() < 0.08}
        layer = {}
        for _ in range(n):
            layer |= {i: max([layer[b] + 1 for a, b in links if a == i], default=0) for i in range(n)
                      if i not in layer and all(b in layer for a, b in links if a == i)}
        got = G.loop_layers(spark.range(n), spark.createDataFrame(sorted(links), "src long, dst long"), local)
        assert rows(got) == sorted(((i, layer.get(i)) for i in range(n)), key=str)
