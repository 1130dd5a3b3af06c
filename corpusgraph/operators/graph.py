"""Graph jobs over ``nodes(id, type, ...)`` and ``edges(src, dst, kind)``.

With a ``project`` column, in all tables or in none, an id belongs to its project and equal ids of two projects are
two nodes; results then carry the project too. A row without project or id meets nothing.

Edges are a multiset; reachability uses distinct links, counts use rows. Results
are pair tables, not arrays, so a hub with many neighbours stays distributed.

Jobs that walk the graph solve whole projects in a task where these are small (``plans/bins.py``; the
``limit`` arguments say how small) and loop over the cluster on long numbers for the others.
"""

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans import bins, reach
from corpusgraph.plans.bins import LINK, NODE, SEED, Bin
from corpusgraph.plans.dense import Names
from corpusgraph.plans.loops import RoundLimit, closure, cut, cut_counting, distinct_links, jump_to_end

#: Links (for all-pairs answers: their square) of a project that a task solves in memory.
LOCAL_LINKS = 200_000
LOCAL_PAIRS = 4_000_000


def keys_of(*tables: DataFrame) -> list[str]:
    """The columns that name the project: in all tables or in none."""
    named = {"project" in t.columns for t in tables}
    if len(named) > 1:
        raise ValueError("either all tables name the project or none")
    return ["project"] if named.pop() else []


def _types(keys: list[str], table: DataFrame) -> dict[str, str]:
    return {k: table.schema[k].dataType.simpleString() for k in keys}


def _only(table: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """Rows of the large projects."""
    project = F.to_json(F.struct(*keys)) if keys else F.lit("")
    return table.withColumn("_p", project).join(large.withColumnRenamed("project", "_p"), "_p", "left_semi").drop("_p")


def _all(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return cut(result)


def _frame(b: Bin, nodes: np.ndarray, **columns) -> pd.DataFrame:
    return pd.DataFrame({"project": b.project[nodes], **columns})


def dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, dependent)`` from edges of every kind; NULL for a node without dependents."""
    keys = keys_of(nodes, edges)
    pairs = edges.select(*keys, F.col("dst").alias("id"), F.col("src").alias("dependent")).distinct()
    return nodes.select(*keys, "id").join(pairs, [*keys, "id"], "left")


def dependencies(edges: DataFrame) -> DataFrame:
    """Distinct ``(id, dependency)``."""
    return edges.select(*keys_of(edges), F.col("src").alias("id"), F.col("dst").alias("dependency")).distinct()


def edges_from_adjacency(adjacency: DataFrame) -> DataFrame:
    """One import edge per entry of a ``depends_on`` array."""
    return adjacency.select(*keys_of(adjacency), F.col("id").alias("src"), F.explode("depends_on").alias("dst"), F.lit("import").alias("kind"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge rows with an endpoint that is no node; duplicates stay."""
    keys = keys_of(nodes, edges)
    ids = nodes.select(*keys, "id").distinct()
    marked = (
        edges.join(ids.select(*keys, F.col("id").alias("src"), F.lit(True).alias("_s")), [*keys, "src"], "left")
        .join(ids.select(*keys, F.col("id").alias("dst"), F.lit(True).alias("_d")), [*keys, "dst"], "left")
    )
    return marked.filter("_s IS NULL OR _d IS NULL").select(*edges.columns)


def _reached(seeds: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """``(seed, id)`` over ``edges (src, dst)``, the seed included."""
    keys = keys_of(seeds, edges)
    rows = _all(bins.records(keys, LINK, edges, "src", "dst"), bins.records(keys, SEED, seeds, "id"))
    size = F.count("*").cast("double")
    weights = rows.groupBy("project").agg((size * size).alias("weight"))
    kind = seeds.schema["id"].dataType.simpleString()

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        b = Bin(frame)
        seed, node = bins.reach_pairs(b, b.src, b.dst, np.unique(b.of_kind(SEED)))
        return _frame(b, seed, seed=b.id[seed], id=b.id[node])

    def far(large: DataFrame) -> DataFrame:
        some, links = _only(seeds, keys, large).select(*keys, "id"), _only(edges, keys, large).select(*keys, "src", "dst")
        names = Names(keys, some, links.select(*keys, "src"), links.select(*keys, "dst"))
        pairs = reach.reach_pairs(names.number(some, "id").distinct(), names.number(links, "src", "dst"))
        return names.name(pairs, "seed", "id").select(*keys, F.col("seed").cast("string"), F.col("id").cast("string"))

    pairs = bins.solve(rows, weights, _types(keys, seeds), limit, local, "seed string, id string", far)
    return pairs.select(*keys, F.col("seed").cast(kind).alias("seed"), F.col("id").cast(kind).alias("id"))


def reachable(seeds: DataFrame, edges: DataFrame, limit: int = LOCAL_PAIRS) -> DataFrame:
    """``(seed, id)``: everything a seed needs, itself included, unknown ids too."""
    return _reached(seeds.distinct(), edges, limit)


def transitive_dependents(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = LOCAL_PAIRS) -> DataFrame:
    """``(seed, id)``: everything that needs a seed, the seed itself left out.

    The walk goes through nodes only: an unknown source is reported, not expanded.
    """
    keys = keys_of(seeds, nodes, edges)
    flipped = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    known = flipped.join(nodes.select(*keys, F.col("id").alias("src")).distinct(), [*keys, "src"], "left_semi")
    start = seeds.join(nodes, [*keys, "id"], "left_semi").select(*keys, "id").distinct()
    return _reached(start, known, limit).filter("id <> seed")


def neighbourhood(nodes: DataFrame, edges: DataFrame, focus: DataFrame, depth: int = 1, limit: int = LOCAL_PAIRS) -> DataFrame:
    """``(focus, id, distance)`` up to ``depth`` hops in both directions, real nodes only."""
    keys = keys_of(nodes, edges, focus)
    kind = nodes.schema["id"].dataType.simpleString()
    rows = _all(bins.records(keys, LINK, edges, "src", "dst"), bins.records(keys, NODE, nodes, "id"), bins.records(keys, SEED, focus, "id"))
    # the pairs that one hop from every neighbour makes at most: per node the square of its degree
    ends = rows.filter(F.col("kind") == LINK).select("project", F.explode(F.array("a", "b")).alias("id")).groupBy("project", "id").agg(
        F.count("*").alias("n")).groupBy("project").agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(max(depth, 1)))).alias("n"))
    weights = rows.groupBy("project").agg(F.count("*").alias("m")).join(ends, "project", "left").select(
        "project", (F.col("m") + F.coalesce("n", F.lit(0))).alias("weight"))

    def local(table: pa.Table) -> pa.Table:
        b = Bin(table.to_pandas())
        real = b.is_node()
        use = real[b.src] & real[b.dst] & (b.src != b.dst)
        one, two = b.src[use], b.dst[use]
        link = np.unique(np.stack([np.concatenate([one, two]), np.concatenate([two, one])], axis=1), axis=0)
        starts, targets = bins.lists(b.n, link[:, 0], link[:, 1])
        start = np.unique(b.of_kind(SEED))
        start = start[real[start]]
        pairs = [(start, start, np.zeros(len(start), np.int32))]
        seen = frontier = start * b.n + start
        for hop in range(1, depth + 1):
            other, at = bins.around(frontier % b.n, starts, targets)
            frontier = np.setdiff1d((frontier // b.n)[at] * b.n + other, seen)
            seen = np.union1d(seen, frontier)
            pairs.append((frontier // b.n, frontier % b.n, np.full(len(frontier), hop, np.int32)))
        first, other, distance = (np.concatenate(x) for x in zip(*pairs))
        # pairs are many times the nodes: texts are taken by number and never made one by one
        ids, first = pa.array(b.id, pa.string()), pa.array(first)
        return pa.table([pa.array(b.project, pa.string()).take(first), ids.take(first), ids.take(pa.array(other)), pa.array(distance)],
                        ["project", "focus", "id", "distance"])

    def far(large: DataFrame) -> DataFrame:
        real, links, start = (_only(x, keys, large) for x in (nodes.select(*keys, "id"), edges.select(*keys, "src", "dst"), focus.select(*keys, "id")))
        names = Names(keys, real, links.select(*keys, "src"), links.select(*keys, "dst"), start)
        near = _near(names.number(real, "id").distinct(), names.number(links, "src", "dst"), names.number(start, "id").distinct(), depth)
        return names.name(near, "focus", "id").select(*keys, F.col("focus").cast("string"), F.col("id").cast("string"), "distance")

    found = bins.solve(rows, weights, _types(keys, nodes), limit, local, "focus string, id string, distance int", far, arrow=True)
    return found.select(*keys, F.col("focus").cast(kind).alias("focus"), F.col("id").cast(kind).alias("id"), "distance")


def _near(nodes: DataFrame, edges: DataFrame, focus: DataFrame, depth: int) -> DataFrame:
    ids = cut(nodes)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = distinct_links(both).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = cut(links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"))
    seen = focus.join(ids, "id", "left_semi").select(F.col("id").alias("focus"), "id", F.lit(0).alias("distance"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.select("focus", F.col("id").alias("src")).join(links, "src").select(
            "focus", F.col("dst").alias("id")).distinct()
        frontier = step.join(seen, ["focus", "id"], "left_anti").withColumn("distance", F.lit(hop))
        if hop < depth:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both endpoints in ``ids``."""
    keys = keys_of(edges, ids)
    inside = ids.select(*keys, "id").distinct()
    return edges.join(inside.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").join(
        inside.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame, limit: int = LOCAL_LINKS) -> DataFrame:
    """``(id, reason)`` of nodes that no root reaches, every root included."""
    keys = keys_of(nodes, edges)
    kind = nodes.schema["id"].dataType.simpleString()
    rows = _all(bins.records(keys, LINK, edges, "src", "dst"), bins.records(keys, NODE, nodes, "id", "type"))
    weights = rows.groupBy("project").agg(F.count("*").cast("double").alias("weight"))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        b = Bin(frame)
        real = b.is_node()
        use = real[b.src] & (b.src != b.dst)
        starts, targets = bins.lists(b.n, b.src[use], b.dst[use])
        inner = np.zeros(b.n, bool)
        inner[b.dst[use]] = True
        seen, frontier = np.zeros(b.n, bool), np.flatnonzero(real & ~inner)
        while len(frontier):
            frontier = np.unique(bins.around(frontier, starts, targets)[0])
            frontier = frontier[~seen[frontier]]
            seen[frontier] = True
        needs = np.zeros(b.n, bool)
        needs[b.src] = True
        at = np.flatnonzero((b.kind == NODE) & ~seen[b.a])
        node = b.a[at]
        reason = np.where(needs[node], "entry_point", np.where(b.b[at] == "asset", "unreferenced_asset", "unreferenced"))
        return _frame(b, node, id=b.id[node], reason=reason)

    def far(large: DataFrame) -> DataFrame:
        real, links = _only(nodes, keys, large).select(*keys, "id", "type").distinct(), _only(edges, keys, large).select(*keys, "src", "dst")
        names = Names(keys, real.select(*keys, "id"), links.select(*keys, "src"), links.select(*keys, "dst"))
        found = _loop_orphans(cut(names.number(real, "id")), cut(names.number(links, "src", "dst")))
        return names.name(found, "id").select(*keys, F.col("id").cast("string"), "reason")

    found = bins.solve(rows, weights, _types(keys, nodes), limit, local, "id string, reason string", far)
    return found.withColumn("id", F.col("id").cast(kind))


def _loop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    real = distinct_links(edges).filter("src <> dst").join(
        nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    real = cut(real)
    targets = real.select(F.col("dst").alias("id")).distinct()
    roots = cut(nodes.select("id").distinct().join(targets, "id", "left_anti"))
    seen = closure(roots, real).filter("hops > 0").select("id")
    unreached = nodes.select("id", "type").distinct().join(seen, "id", "left_anti")
    needs = edges.select(F.col("src").alias("id"), F.lit(True).alias("needs")).distinct()
    reason = (
        F.when(F.col("needs"), "entry_point")
        .when(F.col("type") == "asset", "unreferenced_asset")
        .otherwise("unreferenced")
    )
    return unreached.join(needs, "id", "left").select("id", reason.alias("reason"))


def cycle_groups(edges: DataFrame, limit: int = LOCAL_LINKS) -> DataFrame:
    """``(id, cycle)``: strongly connected groups of two or more nodes, and self-loops; named by the smallest member."""
    keys = keys_of(edges)
    kind = edges.schema["src"].dataType.simpleString()
    rows = _all(bins.records(keys, LINK, edges, "src", "dst"))
    weights = rows.groupBy("project").agg(F.count("*").cast("double").alias("weight"))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        b = Bin(frame)
        group, made = bins.groups(b.n, b.src, b.dst)
        cyclic = np.bincount(group, minlength=made) > 1
        cyclic[group[b.src[b.src == b.dst]]] = True
        name = np.full(made, b.n)
        np.minimum.at(name, group, np.arange(b.n))
        node = np.flatnonzero(cyclic[group])
        return _frame(b, node, id=b.id[node], cycle=b.id[name[group[node]]])

    def far(large: DataFrame) -> DataFrame:
        links = _only(edges, keys, large).select(*keys, "src", "dst").distinct()
        names = Names(keys, links.select(*keys, "src"), links.select(*keys, "dst"))
        found = loop_cycle_groups(names.number(links, "src", "dst"), limit)
        return names.name(found, "id", "cycle").select(*keys, F.col("id").cast("string"), F.col("cycle").cast("string"))

    found = bins.solve(rows, weights, _types(keys, edges), limit, local, "id string, cycle string", far)
    return found.select(*keys, F.col("id").cast(kind).alias("id"), F.col("cycle").cast(kind).alias("cycle"))


def trim_ends(links: DataFrame, rounds: int = 2) -> DataFrame:
    """Drop links from nodes without a way in and to nodes without a way out, a few times.

    Leaves such as assets go at once; longer fringes are left to the label rounds.
    """
    for _ in range(rounds):
        links = cut(links.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(
            links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
    return links


def contract_chains(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace runs of nodes with one way in and one way out by their last node.

    Returns the shorter links and ``(id, stand_in)`` for the nodes taken out. Long
    simple paths would otherwise cost one propagation round per node.
    """
    outs = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.first("dst").alias("only"))
    ins = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    thin, counts = cut_counting(
        outs.join(ins, "id").filter("n_out = 1 AND n_in = 1 AND id <> only").select("id", "only"))
    if not counts["rows"]:
        return links, thin.select("id", F.col("id").alias("stand_in"))
    thin_ids = thin.select(F.col("id").alias("only"), F.lit(True).alias("inner"))
    # Inside a run the pointer goes on; at its last node it leaves to a thick node.
    chain = thin.join(thin_ids, "only", "left").select("id", F.when(F.col("inner"), F.col("only")).alias("parent"))
    ends = jump_to_end(chain)
    # A run that bites its own tail is a cycle of thin nodes: its smallest id stands for all.
    loops = ends.filter("cyclic").select("id", F.col("low").alias("stand_in"))
    stand = cut(ends.filter("NOT cyclic").select("id", F.col("root").alias("stand_in")).unionByName(loops))
    short = (
        links.join(stand.select(F.col("id").alias("src"), F.col("stand_in").alias("s2")), "src", "left")
        .join(stand.select(F.col("id").alias("dst"), F.col("stand_in").alias("d2")), "dst", "left")
        .select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"),
                F.coalesce(F.col("s2") == F.col("d2"), F.lit(False)).alias("inside"))
    )
    outside = short.filter("NOT inside").select("src", "dst").distinct()
    closed = loops.select(F.col("stand_in").alias("src"), F.col("stand_in").alias("dst")).distinct()
    return cut(outside.unionByName(closed)), stand


def loop_cycle_groups(edges: DataFrame, local: int = LOCAL_LINKS, max_rounds: int = 100_000) -> DataFrame:
    """:func:`cycle_groups` of ``(src, dst)`` by rounds over the cluster.

    Thin runs are contracted first. Then every node learns the smallest id that
    reaches it and the smallest id it reaches; where both agree the node belongs to
    that id's group. Links between nodes that differ in either label join no group
    and are dropped, grouped nodes leave, the rest is trimmed and goes another round. What is
    left with at most ``local`` links is solved in one task. A group is named by its smallest member.
    """
    links = cut(distinct_links(edges))
    self_loops = links.filter("src = dst").select("src")
    short, stand = contract_chains(trim_ends(links.filter("src <> dst")))
    closed = cut(short.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("cycle")))
    found = None
    work, counts = cut_counting(short.filter("src <> dst"))
    for _ in range(max_rounds):
        if not counts["rows"]:
            break
        if counts["rows"] <= local:
            group = cut(work.groupBy().applyInPandas(_last_groups, "id long, cycle long"))
            found = group if found is None else found.unionByName(group)
            break
        labels = _both_labels(work, max_rounds)
        group = labels.filter("fore = back").select("id", F.col("fore").alias("cycle"))
        found = group if found is None else found.unionByName(group)
        loose = labels.filter("fore <> back")
        same = work.join(loose.toDF("src", "f1", "b1"), "src").join(loose.toDF("dst", "f2", "b2"), "dst").filter(
            "f1 = f2 AND b1 = b2").select("src", "dst")
        work, counts = cut_counting(trim_ends(cut(same), 1))
    else:
        raise RoundLimit("cycle groups did not settle")
    # One node alone is no cycle, unless it stands for a run that closed on itself.
    if found is not None:
        several = found.groupBy("cycle").agg(F.count("*").alias("n")).filter("n > 1").select("cycle")
        closed = closed.unionByName(found.join(several, "cycle", "left_semi").select("id", "cycle"))
    found = cut(closed)
    # A contracted node belongs to the group of the node that stands in for it.
    inner = stand.filter("id <> stand_in").join(
        found.select(F.col("id").alias("stand_in"), "cycle").distinct(), "stand_in").select("id", "cycle")
    members = cut(found.unionByName(inner).dropDuplicates(["id"]))
    names = members.groupBy("cycle").agg(F.min("id").alias("name"))
    groups = members.join(names, "cycle").select("id", F.col("name").alias("cycle"))
    lonely = self_loops.select(F.col("src").alias("id")).join(groups.select("id"), "id", "left_anti")
    return groups.unionByName(lonely.select("id", F.col("id").alias("cycle")))


def _last_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """Groups of two or more nodes of what is left, in one task."""
    ids, place = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
    group, made = bins.groups(len(ids), place[:len(frame)], place[len(frame):])
    name = np.full(made, len(ids))
    np.minimum.at(name, group, np.arange(len(ids)))
    node = np.flatnonzero(np.bincount(group, minlength=made)[group] > 1)
    return pd.DataFrame({"id": ids[node], "cycle": ids[name[group[node]]]})


def _both_labels(links: DataFrame, max_rounds: int) -> DataFrame:
    """``(id, fore, back)``: smallest id that reaches a node, and smallest id it reaches.

    Both directions run in the same rounds, and only nodes whose label just fell
    offer it to their neighbours.
    """
    both = cut(links.select(F.lit(0).alias("way"), "src", "dst").unionByName(
        links.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    ids = both.select("way", F.col("src").alias("id")).unionByName(both.select("way", F.col("dst").alias("id"))).distinct()
    state = cut(ids.select("way", "id", F.col("id").alias("label")))
    moved = state
    for _ in range(max_rounds):
        offers = moved.select("way", F.col("id").alias("src"), "label").join(both, ["way", "src"]).groupBy(
            "way", F.col("dst").alias("id")).agg(F.min("label").alias("offer"))
        fell = F.coalesce(F.col("offer") < F.col("label"), F.lit(False))
        new, counts = cut_counting(state.join(offers, ["way", "id"], "left").select(
            "way", "id", F.least("label", F.coalesce("offer", "label")).alias("label"), fell.alias("fell")),
            fell=F.col("fell"))
        state = new.select("way", "id", "label")
        if not counts["fell"]:
            break
        moved = new.filter("fell").select("way", "id", "label")
    else:
        raise RoundLimit("labels did not settle")
    return cut(state.groupBy("id").agg(
        F.min(F.when(F.col("way") == 0, F.col("label"))).alias("fore"),
        F.min(F.when(F.col("way") == 1, F.col("label"))).alias("back")))


def layers(nodes: DataFrame, edges: DataFrame, limit: int = LOCAL_LINKS) -> DataFrame:
    """``(id, layer)``: 0 without in-graph dependencies, else one more than the deepest;
    NULL for nodes on a cycle or depending on one."""
    keys = keys_of(nodes, edges)
    kind = nodes.schema["id"].dataType.simpleString()
    rows = _all(bins.records(keys, LINK, edges, "src", "dst"), bins.records(keys, NODE, nodes, "id"))
    weights = rows.groupBy("project").agg(F.count("*").cast("double").alias("weight"))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        b = Bin(frame)
        real = b.is_node()
        use = real[b.src] & real[b.dst]
        layer, node = bins.layer_numbers(b.n, b.src[use], b.dst[use]), np.flatnonzero(real)
        return _frame(b, node, id=b.id[node], layer=pd.array(np.where(layer[node] < 0, 0, layer[node]), "Int32")).assign(
            layer=lambda x: x["layer"].mask(layer[node] < 0))

    def far(large: DataFrame) -> DataFrame:
        real, links = _only(nodes, keys, large).select(*keys, "id").distinct(), _only(edges, keys, large).select(*keys, "src", "dst")
        names = Names(keys, real, links.select(*keys, "src"), links.select(*keys, "dst"))
        found = loop_layers(names.number(real, "id"), names.number(links, "src", "dst"), limit)
        return names.name(found, "id").select(*keys, F.col("id").cast("string"), "layer")

    found = bins.solve(rows, weights, _types(keys, nodes), limit, local, "id string, layer int", far)
    return found.withColumn("id", F.col("id").cast(kind))


#: Targets of links in :func:`loop_layers` that stand for all placed nodes, and for all nodes on or above a cycle.
PLACED, CYCLIC = -1, -2


def loop_layers(nodes: DataFrame, edges: DataFrame, local: int = LOCAL_LINKS, max_rounds: int = 100_000) -> DataFrame:
    """:func:`layers` of numbered nodes (from 0) by rounds over the cluster.

    A link weighs how many layers its source is above its target at least. A node with one target lies exactly that
    much above it, so each round follows all such nodes to the end of their chains by pointer doubling, whatever
    their length, and links to them become heavier links to the ends. All placed nodes are one target, so
    placing a node whose targets are placed is the same step. What is left with at most ``local`` links is solved in one task.
    """
    ids = cut(nodes.select("id").distinct())
    inside = distinct_links(edges).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    inside = cut(inside.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    leaves = ids.join(inside.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    ends = leaves.select("id", F.lit(PLACED).cast("long").alias("root"), F.lit(0).cast("long").alias("steps"))
    found, work = [], inside.withColumn("w", F.lit(1).cast("long"))
    for _ in range(max_rounds):
        ends, _ = cut_counting(ends)
        found.append(ends)
        moved = work.join(ends.select(F.col("id").alias("src")), "src", "left_anti").join(
            ends.withColumnRenamed("id", "dst"), "dst", "left").select(
            "src", F.coalesce("root", "dst").alias("dst"), (F.col("w") + F.coalesce("steps", F.lit(0))).alias("w"))
        work, counts = cut_counting(moved.groupBy("src", "dst").agg(F.max("w").alias("w")))
        if not counts["rows"]:
            break
        if counts["rows"] <= local:
            found.append(cut(work.groupBy().applyInPandas(_last_layers, "id long, root long, steps long")))
            break
        # a node above a cycle is above nothing else
        targets = work.groupBy("src").agg(F.count("*").alias("n"), F.min(F.struct("dst", "w")).alias("least"))
        single = targets.filter((F.col("n") == 1) | (F.col("least.dst") == CYCLIC)).select(
            F.col("src").alias("id"), F.when(F.col("least.dst") >= 0, F.col("least.dst")).alias("target"), "least.*")
        chain, counts = cut_counting(single)
        if not counts["rows"]:  # every node left leads to a cycle
            found.append(work.select(F.col("src").alias("id"), F.lit(CYCLIC).cast("long").alias("root"), F.lit(0).cast("long").alias("steps")).distinct())
            break
        inner = chain.select(F.col("id").alias("target"), F.lit(True).alias("inner"))
        walked = jump_to_end(chain.join(inner, "target", "left").select(
            "id", F.when(F.col("inner"), F.col("target")).alias("parent"), F.col("w").alias("weight")))
        # the chain's last node points to its own target, placed or with several targets
        last = chain.select(F.col("id").alias("last"), "dst", "w")
        ends = walked.join(last, walked["root"] == last["last"]).select(
            "id", F.when(F.col("cyclic"), F.lit(CYCLIC).cast("long")).otherwise(F.col("dst")).alias("root"), (F.col("steps") + F.col("w")).alias("steps"))
    else:
        raise RoundLimit("layers did not settle")
    placed = None
    for step in reversed(found):
        done = step.filter(F.col("root") < 0).select("id", F.when(F.col("root") == PLACED, F.col("steps")).alias("layer"))
        if placed is not None:
            done = done.unionByName(step.filter(F.col("root") >= 0).join(placed.withColumnRenamed("id", "root"), "root").select(
                "id", (F.col("steps") + F.col("layer")).alias("layer")))
            done = placed.unionByName(done)
        placed = cut(done)
    return placed.select("id", F.col("layer").cast("int").alias("layer"))


def _last_layers(frame: pd.DataFrame) -> pd.DataFrame:
    """What is left, in one task: ``(id, root, steps)`` with every root placed or cyclic."""
    ids, place = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
    src, dst, w = place[:len(frame)], place[len(frame):], frame["w"].to_numpy()
    starts, order = bins.lists(len(ids), dst, np.arange(len(src)))
    open_, value = np.bincount(src, minlength=len(ids)), np.zeros(len(ids), np.int64)
    open_[ids == CYCLIC] = 1
    ready, settled = np.flatnonzero(open_ == 0), np.zeros(len(ids), bool)
    while len(ready):
        settled[ready] = True
        link, at = bins.around(ready, starts, order)
        np.maximum.at(value, src[link], value[ready[at]] + w[link])
        touched, times = np.unique(src[link], return_counts=True)
        open_[touched] -= times
        ready = touched[open_[touched] == 0]
    some = ids >= 0
    return pd.DataFrame({"id": ids[some], "root": np.where(settled[some], PLACED, CYCLIC), "steps": value[some]})


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst", "kind")


def row_fingerprints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One digest per node and edge row, equal for equal rows in any order."""
    node = F.sha2(F.concat_ws("|", F.lit("n"), "id", "type", "engine"), 256)
    edge = F.sha2(F.concat_ws("|", F.lit("e"), "src", "dst", "kind"), 256)
    return nodes.select(node.alias("digest")).unionByName(edges.select(edge.alias("digest")))


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Order-independent digest of a whole graph in one row.

    Row digests are summed in eight 32-bit lanes, so a task gives one row and none holds the graph.
    """
    lanes = [f"s{i}" for i in range(8)]
    parts = row_fingerprints(nodes, edges).select(F.unhex("digest").alias("digest")).mapInArrow(
        _lane_sums, ", ".join(["rows bigint", *[f"{x} decimal(38,0)" for x in lanes]]))
    total = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), *[F.sum(x).alias(x) for x in lanes])
    return total.select("rows", F.sha2(F.concat_ws("|", *[F.col(x).cast("string") for x in lanes]), 256).alias("digest"))


def _lane_sums(batches):
    """One row per task: its digests, and the sums of their eight 32-bit numbers."""
    rows, sums = 0, [0] * 8
    for batch in batches:
        digests = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").reshape(-1, 8)
        rows, sums = rows + len(digests), [a + int(b) for a, b in zip(sums, digests.sum(axis=0, dtype=np.uint64))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), *[pa.array([Decimal(x)], pa.decimal128(38, 0)) for x in sums]],
                                         ["rows", *[f"s{i}" for i in range(8)]])


def tally(rows: DataFrame) -> DataFrame:
    """``(digest, n)``: how often each digest is there, as bytes."""
    return rows.groupBy(F.unhex("digest").alias("digest")).agg(F.count("*").alias("n"))


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """:func:`tally` of what two extractions share."""
    sides = tally(left).withColumn("right", F.lit(0)).unionByName(tally(right).withColumn("right", F.lit(1)))
    counted = sides.groupBy("digest").agg(F.count("*").alias("sides"), F.min("n").alias("n"))
    return counted.filter("sides = 2").select("digest", "n")


def same_graph(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(digest, side, n)`` of row digests that only one of two extractions has, or has ``n`` times more; both given as :func:`tally`."""
    both = left.select("digest", "n").unionByName(right.select("digest", (-F.col("n")).alias("n")))
    net = both.groupBy("digest").agg(F.sum("n").alias("n")).filter("n <> 0")
    return net.select(F.lower(F.hex("digest")).alias("digest"), F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.abs("n").alias("n"))


def _counted(keys: list[str], metric: str, frame: DataFrame, key: str | None = None) -> DataFrame:
    by = [*keys, *([key] if key else [])]
    counts = frame.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.lit(metric).alias("metric"), (F.col(key) if key else F.lit("")).alias("key"), "n")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(metric, key, n)`` rows per project: totals, orphans, counts by type and by edge kind.

    Counts of nothing have no row, but for the one graph of tables without projects.
    """
    keys = keys_of(nodes, edges)
    parts = [_counted(keys, "nodes", nodes), _counted(keys, "edges", edges), _counted(keys, "orphans", orphans(nodes, edges)),
             _counted(keys, "type", nodes, "type"), _counted(keys, "kind", edges, "kind")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def frequency(frame: DataFrame, column: str) -> DataFrame:
    """``value (n)`` items, most frequent first, as rows with a position-free order key."""
    return frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def frequency_text(frame: DataFrame, column: str) -> DataFrame:
    """One text ``a (3), b (1)``. The column must be an enumeration: one entry per value."""
    counts = frequency(frame, column)
    entry = F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))
    items = F.transform(F.array_sort(F.collect_list(entry)),
                        lambda e: F.concat(e["value"], F.lit(" ("), (-e["n"]).cast("string"), F.lit(")")))
    return counts.agg(F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit("(none)")).alias("text"))


def section_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(metric, n)`` rows per project: nodes, edges, layers, the size of every layer, cyclic, dangling.

    Counts of nothing have no row, but for the one graph of tables without projects.
    """
    keys = keys_of(nodes, edges)
    placed = cut(layers(nodes, edges))
    sizes = placed.filter("layer IS NOT NULL").groupBy(*keys, "layer").agg(F.count("*").alias("n"))
    count = lambda metric, frame: _counted(keys, metric, frame).drop("key")
    parts = [
        count("nodes", nodes), count("edges", edges),
        placed.groupBy(*keys).agg((F.coalesce(F.max("layer") + 1, F.lit(0))).cast("long").alias("n")).select(
            *keys, F.lit("layers").alias("metric"), "n"),
        count("cyclic", placed.filter("layer IS NULL")),
        count("dangling", dangling(nodes, edges)),
        sizes.select(*keys, F.concat(F.lit("layer "), F.col("layer").cast("string")).alias("metric"), "n"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
