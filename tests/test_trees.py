"""Hierarchies solved in tasks and in loops, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import hierarchy as H

LIMITS = [0, 30, 10**9]


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for project, n in ((1, 40), (2, 12), (5, 1), (9, 40)):
        ids = list(range(n))
        for i in ids:
            parent = rng.choice([None, rng.choice(ids), rng.choice(ids), rng.choice(ids), max(i - 1, 0), 999])
            rows.append((project, i, parent, rng.choice([None, "tree", "Rock"]), rng.choice(["", "box 7", "Oak"]), (i * 7) % 5 * 100 + i))
    return rows


def plain(rows):
    """Per project ``id -> (parent, ord, depth, root, orphan)``, children by document order, and endless ids."""
    out = {}
    for project in sorted({r[0] for r in rows}):
        own = {r[1]: r for r in rows if r[0] == project}
        up = {i: (r[2] if r[2] in own and r[2] != i else None) for i, r in own.items()}

        def chain(i):
            seen = [i]
            while up[seen[-1]] is not None and up[seen[-1]] not in seen:
                seen.append(up[seen[-1]])
            return seen, up[seen[-1]]

        endless, opened = set(), set()
        for i in own:
            seen, back = chain(i)
            if back is not None:
                endless.add(i)
                loop = seen[seen.index(back):]
                opened.add(min(loop, key=lambda x: own[x][5]))
        for i in opened:
            up[i] = None
        tree = {}
        for i, r in own.items():
            seen, _ = chain(i)
            tree[i] = (up[i], r[5], len(seen) - 1, seen[-1], r[2] is not None and up[i] is None)
        out[project] = tree, endless
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "project long, id long, parent long, prefab string, name string, ord long").repartition(4)


def got(table):
    return sorted(map(tuple, table.collect()), key=str)


@pytest.mark.parametrize("limit", LIMITS)
def test_trees_of_several_projects(spark, limit):
    rows = sample(3)
    table = frame(spark, rows)
    want = plain(rows)
    tree = H.build_tree(table, limit=limit)
    built = [(p, i, *v) for p, (t, _) in want.items() for i, v in t.items()]
    assert got(tree.select("project", "id", "parent", "ord", "depth", "root", "orphan")) == sorted(built, key=str)
    assert got(H.cycle_members(table, limit=limit).select("project", "id")) == sorted(((p, i) for p, (_, e) in want.items() for i in e), key=str)
    sizes, places, reasons = [], [], []
    for p, (t, _) in want.items():
        kids = {i: sorted((j for j, v in t.items() if v[0] == i), key=lambda j: t[j][1]) for i in [None, *t]}
        size = lambda i: 1 + sum(size(j) for j in kids[i])
        order = []

        def walk(i):
            order.append(i)
            for j in kids[i]:
                walk(j)

        for i in kids[None]:
            walk(i)
        sizes += [(p, i, size(i), len(kids[i])) for i in t]
        places += [(p, i, t[i][2], order.index(i)) for i in t]
        hit = {r[1] for r in rows if r[0] == p and ("7" in str(r[1]) or "7" in (r[4] or str(r[1])).lower() or "7" in (r[3] or "").lower())}
        above = lambda i: [] if t[i][0] is None else [t[i][0], *above(t[i][0])]
        up, down = {a for i in hit for a in above(i)}, {i for i in t if hit & set(above(i))}
        reasons += [(p, i, "match" if i in hit else "descendant" if i in up else "ancestor") for i in hit | up | down]
    assert got(H.subtree_sizes(tree, limit=limit).select("project", "id", "subtree", "children")) == sorted(sizes, key=str)
    assert got(H.flatten(tree, limit=limit).select("project", "id", "depth", "order_key")) == sorted(places, key=str)
    assert got(H.filter_tree(tree, table, " 7", limit=limit).select("project", "id", "reason")) == sorted(reasons, key=str)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_deep_chain(spark, limit):
    deep = 8000
    chain = spark.range(deep).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    tree = H.build_tree(chain, limit=limit)
    sizes = H.subtree_sizes(tree, limit=limit)
    assert sizes.filter(F.col("subtree") == deep - F.col("id")).count() == deep
    assert H.flatten(tree, limit=limit).filter("order_key = id AND depth = id").count() == deep


def test_empty_and_broken_rows(spark):
    schema = "id long, parent long"
    none = H.build_tree(spark.createDataFrame([], schema))
    assert none.collect() == [] and H.flatten(none).collect() == [] and H.subtree_sizes(none).collect() == []
    some = H.build_tree(spark.createDataFrame([(None, 1), (1, None), (2, 2)], schema))
    assert got(some.select("id", "orphan")) == [(1, False), (2, True)]
