"""Parent-child hierarchies: trees from ``(id, parent, ...)`` rows.

Document order is the order of ``ord`` (the id when there is no such column). With a ``project`` column ids and
parents belong to their project; ids are unique there (see V4), and a row without id or project is left out.

Projects of at most ``limit`` rows are solved whole in a task; larger ones by pointer doubling over the cluster.
There a tree is one chain, its tour: every node is entered, then its children in order, then left. The steps from a
place in the tour to the end give positions and subtree sizes, so no table holds pairs of a node and an ancestor.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.graph import _only, _types, keys_of
from corpusgraph.plans import bins
from corpusgraph.plans.dense import Names, dictionary
from corpusgraph.plans.loops import by_shuffle, cut, jump_to_end
from corpusgraph.plans.running import running_sum

#: Rows of a project that a task solves in memory.
LOCAL_ROWS = 200_000


def _keyed(table: DataFrame) -> tuple[list[str], DataFrame]:
    keys = keys_of(table)
    return keys, table.dropna(subset=[*keys, "id"])


def _records(keys: list[str], table: DataFrame, *columns) -> tuple[DataFrame, DataFrame]:
    """Rows for a bin with ids as text, and the projects' weights."""
    project = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = cut(table.select(project.alias("project"), F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"),
                            *columns))
    return rows, rows.groupBy("project").agg(F.count("*").cast("double").alias("weight"))


def _order(table: DataFrame):
    return F.col("ord") if "ord" in table.columns else F.col("id")


# --- trees in memory ---------------------------------------------------------

def _parents(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row of the parent, -1 without a usable one, and whether one is named."""
    project, ids, parents = (table.column(c).to_pylist() for c in ("project", "id", "parent"))
    place = {key: k for k, key in enumerate(zip(project, ids))}
    up = np.fromiter((-1 if p is None or p == i else place.get((q, p), -1) for q, i, p in zip(project, ids, parents)), np.int64, len(ids))
    return up, np.array([p is not None for p in parents], bool)


def _rank(table: pa.Table) -> np.ndarray:
    order = table.column("ord").combine_chunks()
    return pc.rank(order, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _ends(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of each chain (any node of the cycle if there is none) and the steps to it."""
    end, steps = np.where(up < 0, np.arange(len(up)), up), (up >= 0).astype(np.int64)
    for _ in range(int(len(up)).bit_length()):
        steps, end = steps + steps[end], end[end]
    return end, steps


def _cycles(up: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which chains never end, which nodes are on a cycle, and the least rank of that cycle."""
    end, _ = _ends(up)
    endless = up[end] >= 0
    on = np.zeros(len(up), bool)
    on[end[endless]] = True
    low, jump = rank.copy(), np.where(on, up, np.arange(len(up)))
    for _ in range(int(len(up)).bit_length()):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    return endless, on, low


def _sizes(up: np.ndarray, depth: np.ndarray) -> np.ndarray:
    size = [1] * len(up)
    above = up.tolist()
    for k in np.argsort(-depth, kind="stable").tolist():
        if above[k] >= 0:
            size[above[k]] += size[k]
    return np.array(size, np.int64)


def _positions(table: pa.Table, up: np.ndarray, depth: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places in pre-order, from 0 in each project."""
    project = pc.dictionary_encode(table.column("project").combine_chunks()).indices.to_numpy()
    family = np.where(up >= 0, up, len(up) + project)
    order = np.lexsort((_rank(table), family))
    total = np.cumsum(size[order]) - size[order]
    first = np.ones(len(order), bool)
    first[1:] = family[order][1:] != family[order][:-1]
    before = np.zeros(len(up), np.int64)
    before[order] = total - total[first][np.cumsum(first) - 1]
    above, place = up.tolist(), before.tolist()
    for k in np.argsort(depth, kind="stable").tolist():
        if above[k] >= 0:
            place[k] += place[above[k]] + 1
    return np.array(place, np.int64)


def _hits_around(up: np.ndarray, depth: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """0 for a hit, 1 above one, 2 below one, else 3."""
    out = np.where(hit, 0, 3)
    by_depth = np.argsort(depth, kind="stable").tolist()
    above, has, under = up.tolist(), hit.tolist(), [False] * len(up)
    for k in reversed(by_depth):
        if above[k] >= 0 and has[k]:
            has[above[k]] = True
    inside = hit.tolist()
    for k in by_depth:
        if above[k] >= 0 and inside[above[k]]:
            under[k] = inside[k] = True
    out[(out == 3) & np.array(under, bool)] = 2
    out[(out > 0) & np.array(has, bool)] = 1
    return out


# --- the jobs ----------------------------------------------------------------

def usable_parents(instances: DataFrame) -> DataFrame:
    """``(id, parent, ord, named)`` with self and unknown parents set to NULL."""
    order = F.col("ord") if "ord" in instances.columns else F.col("id")
    ids = instances.select(F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    return instances.select("id", "parent", order.alias("ord"), *[c for c in ("named",) if c in instances.columns]).join(
        by_shuffle(ids), "parent", "left").select(
        "id",
        F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent")).alias("parent"),
        "ord",
        (F.col("named") if "named" in instances.columns else F.col("parent").isNotNull()).alias("named"),
    )


def _numbered(keys: list[str], table: DataFrame, *columns: str) -> tuple[Names, DataFrame]:
    """``(id, parent, ...)`` of large projects with numbers; a parent that is no id is NULL, ``named`` keeps that there was one."""
    names = Names(keys, table.select(*keys, "id"))
    ids = names.table.select(*keys, F.col("id").alias("parent"), F.col("node").alias("_up"))
    own = names.table.select(*keys, "id", F.col("node").alias("_id"))
    met = table.select(*keys, "id", "parent", *columns).join(by_shuffle(own), [*keys, "id"]).join(by_shuffle(ids), [*keys, "parent"], "left")
    return names, cut(met.select(*keys, F.col("_id").alias("id"), F.col("_up").alias("parent"), F.col("parent").isNotNull().alias("named"), *columns))


def build_tree(instances: DataFrame, limit: int = LOCAL_ROWS) -> DataFrame:
    """``(id, parent, ord, depth, root, orphan)``, one row per instance.

    Roots have no parent, themselves or an unknown one; the last two are orphans. A
    cycle is opened at its first member in document order, which becomes an orphan root.
    """
    keys, instances = _keyed(instances)
    ordered = instances.withColumn("ord", _order(instances))
    kind, order_kind = ordered.schema["id"].dataType.simpleString(), ordered.schema["ord"].dataType.simpleString()
    rows, weights = _records(keys, ordered, "ord")

    def local(table: pa.Table) -> pa.Table:
        up, named = _parents(table)
        rank = _rank(table)
        _, on, low = _cycles(up, rank)
        up = np.where(on & (rank == low), -1, up)
        root, depth = _ends(up)
        ids = table.column("id")
        parent = ids.take(pa.array(up, mask=up < 0))
        return pa.table([table.column("project"), ids, parent, table.column("ord"), pa.array(depth), ids.take(pa.array(root)), pa.array(named & (up < 0))],
                        ["project", "id", "parent", "ord", "depth", "root", "orphan"])

    def far(large: DataFrame) -> DataFrame:
        names, table = _numbered(keys, _only(ordered, keys, large), "ord")
        built = _loop_tree(table.drop(*keys))
        up = names.table.select(F.col("node").alias("parent"), F.col("id").alias("_up"))
        named = names.name(built, "id", "root").join(by_shuffle(up), "parent", "left")
        return named.select(*keys, F.col("id").cast("string"), F.col("_up").cast("string").alias("parent"), "ord", "depth",
                            F.col("root").cast("string"), "orphan")

    found = bins.solve(rows, weights, _types(keys, instances), limit, local,
                       f"id string, parent string, ord {order_kind}, depth bigint, root string, orphan boolean", far, arrow=True)
    return cut(found.select(*keys, *[F.col(c).cast(kind).alias(c) for c in ("id", "parent")], "ord", "depth",
                            F.col("root").cast(kind).alias("root"), "orphan"))


def _loop_tree(instances: DataFrame) -> DataFrame:
    links = cut(usable_parents(instances))
    walked = jump_to_end(links)
    broken = cut(walked.filter("on_cycle").join(by_shuffle(links.select("id", "ord")), "id").filter("ord = low").select(
        "id", F.lit(True).alias("opened")))
    opened = links.join(by_shuffle(broken), "id", "left").select(
        "id", F.when(F.col("opened").isNull(), F.col("parent")).alias("parent"), "ord",
        (F.col("named") & (F.col("parent").isNull() | F.coalesce("opened", F.lit(False)))).alias("orphan"))
    opened = cut(opened)
    placed = jump_to_end(opened.select("id", "parent", "ord")).select("id", "root", F.col("steps").alias("depth"))
    return opened.join(by_shuffle(placed), "id")


def _tour(tree: DataFrame) -> DataFrame:
    """``(group, id, position, subtree, depth)`` of ``(group, id, parent, ord, depth)``: places in pre-order over all groups.

    All rows are numbered by (group, parent, document order), so the next sibling of a row is the next number if that
    has the same parent. From these each place of the tour learns the next one: after entering a node its first child or
    leaving it, after leaving it the next sibling or leaving the parent, after a group's last root the next group's first.
    """
    up = F.coalesce("parent", F.lit(-1).cast("long"))
    rows = cut(dictionary(tree.select("group", up.alias("up"), F.col("ord").isNotNull().alias("_o"), "ord", "id", "depth"), "seq"))
    after = rows.select((F.col("seq") - 1).alias("seq"), F.col("group").alias("g2"), F.col("up").alias("up2"), F.col("id").alias("next"))
    roots = F.col("up") == -1
    met = rows.join(by_shuffle(after), "seq", "left").select(
        "group", "id", "up", "seq", "depth", F.when((F.col("g2") == F.col("group")) & (F.col("up2") == F.col("up")), F.col("next")).alias("next"))
    first = rows.groupBy("group", "up").agg(F.min_by("id", "seq").alias("child"))
    children = first.filter(~roots).select(F.col("up").alias("id"), "child")
    groups = first.filter(roots).select("group", F.col("child").alias("start"))
    # the next group's first root follows a group's last one
    order = cut(dictionary(groups.select("group", "start"), "at"))
    following = order.join(order.select((F.col("at") - 1).alias("at"), F.col("start").alias("onward")), "at", "left").select("group", "onward")
    met = met.join(by_shuffle(children), "id", "left").join(following, "group", "left")
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    arcs = met.select(F.inline(F.array(
        F.struct(enter("id").alias("id"), F.coalesce(enter("child"), leave("id")).alias("parent")),
        F.struct(leave("id").alias("id"), F.coalesce(enter("next"), F.when(roots, enter("onward")).otherwise(leave("up"))).alias("parent")))))
    steps = cut(jump_to_end(cut(arcs)).select("id", "steps"))
    longest = steps.agg(F.max("steps").alias("n")).first()["n"]
    sides = steps.groupBy(F.expr("id div 2").alias("id")).agg(
        F.max("steps").alias("entered"), F.min("steps").alias("left"))
    # places before the entry: an entry and an exit for each node finished, an entry for each ancestor
    return rows.select("group", "id", "depth").join(by_shuffle(sides), "id").select(
        "group", "id", "depth", F.expr(f"({longest or 0}L - entered + depth) div 2").alias("position"),
        F.expr("(entered - left + 1) div 2").alias("subtree"))


def _toured(keys: list[str], tree: DataFrame, large: DataFrame) -> tuple[Names, DataFrame]:
    names, table = _numbered(keys, _only(tree, keys, large), "ord", "depth")
    group = dictionary(table.select(*keys).distinct(), "group") if keys else None
    table = table.join(cut(group), keys) if keys else table.withColumn("group", F.lit(0).cast("long"))
    return names, cut(_tour(table.select("group", "id", "parent", "ord", "depth")))


def _tree_rows(tree: DataFrame) -> tuple[list[str], DataFrame]:
    keys, tree = _keyed(tree)
    return keys, tree.withColumn("ord", _order(tree)).withColumn("depth", F.col("depth").cast("long"))


def subtree_sizes(tree: DataFrame, limit: int = LOCAL_ROWS) -> DataFrame:
    """``(id, subtree, children)``; the node itself counts in ``subtree``."""
    keys, tree = _tree_rows(tree)
    kind = tree.schema["id"].dataType.simpleString()
    rows, weights = _records(keys, tree, "depth")

    def local(table: pa.Table) -> pa.Table:
        up, _ = _parents(table)
        size = _sizes(up, table.column("depth").to_numpy())
        return pa.table([table.column("project"), table.column("id"), pa.array(size), pa.array(np.bincount(up[up >= 0], minlength=len(up)))],
                        ["project", "id", "subtree", "children"])

    def far(large: DataFrame) -> DataFrame:
        names, tour = _toured(keys, tree, large)
        some = _only(tree, keys, large)
        children = some.filter("parent IS NOT NULL").groupBy(*keys, F.col("parent").alias("id")).agg(F.count("*").alias("children"))
        return names.name(tour.select("id", "subtree"), "id").join(by_shuffle(children), [*keys, "id"], "left").select(
            *keys, F.col("id").cast("string"), "subtree", F.coalesce("children", F.lit(0).cast("long")).alias("children"))

    found = bins.solve(rows, weights, _types(keys, tree), limit, local, "id string, subtree bigint, children bigint", far, arrow=True)
    return found.withColumn("id", F.col("id").cast(kind))


def filter_tree(tree: DataFrame, instances: DataFrame, query: str, limit: int = LOCAL_ROWS) -> DataFrame:
    """``(id, reason)``: matches, their ancestors (``descendant``), their descendants (``ancestor``)."""
    needle = query.strip().lower()
    keys, tree = _tree_rows(tree)
    kind = tree.schema["id"].dataType.simpleString()
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id").cast("string"))
    test = (F.lower(F.col("id").cast("string")).contains(needle) | F.lower(label).contains(needle)
            | F.lower("prefab").contains(needle))
    hits = instances.filter(test).select(*keys, "id", F.lit(True).alias("hit")).distinct()
    marked = cut(tree.join(by_shuffle(hits), [*keys, "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    rows, weights = _records(keys, marked, "depth", "hit")
    reasons = ["match", "descendant", "ancestor"]

    def local(table: pa.Table) -> pa.Table:
        up, _ = _parents(table)
        found = _hits_around(up, table.column("depth").to_numpy(), table.column("hit").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(found < 3)
        return pa.table([table.column("project").take(pa.array(at)), table.column("id").take(pa.array(at)),
                         pa.array([reasons[k] for k in found[at]], pa.string())], ["project", "id", "reason"])

    def far(large: DataFrame) -> DataFrame:
        names, tour = _toured(keys, tree, large)
        some = names.number(_only(marked, keys, large).filter("hit").select(*keys, "id"), "id").withColumn("hit", F.lit(1))
        met = cut(tour.join(by_shuffle(some), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0))))
        n = met.count()
        counted = cut(running_sum(met.select("position", "hit"), n, "hit", "upto").select("position", "upto"))
        # a node has hits below it if more are found up to the end of its subtree than up to itself
        last = counted.select(F.col("position").alias("last"), F.col("upto").alias("at_last"))
        below = met.withColumn("last", F.col("position") + F.col("subtree") - 1).join(by_shuffle(last), "last").join(by_shuffle(counted), "position")
        # a node is below a hit if more of their subtrees began before it than ended
        ends = met.filter("hit = 1 AND subtree > 1").select(F.inline(F.array(
            F.struct((F.col("position") + 1).alias("position"), F.lit(1).alias("open")),
            F.struct((F.col("position") + F.col("subtree")).alias("position"), F.lit(-1).alias("open"))))).groupBy("position").agg(
            F.sum("open").alias("open"))
        opened = met.select("position").join(by_shuffle(ends), "position", "left").select("position", F.coalesce("open", F.lit(0)).alias("open"))
        inside = running_sum(opened, n, "open", "within").select("position", "within")
        reason = F.when(F.col("hit") == 1, reasons[0]).when(F.col("at_last") > F.col("upto"), reasons[1]).when(F.col("within") > 0, reasons[2])
        found = below.join(by_shuffle(inside), "position").select("id", reason.alias("reason")).filter("reason IS NOT NULL")
        return names.name(found, "id").select(*keys, F.col("id").cast("string"), "reason")

    found = bins.solve(rows, weights, _types(keys, tree), limit, local, "id string, reason string", far, arrow=True)
    return found.withColumn("id", F.col("id").cast(kind))


def flatten(tree: DataFrame, limit: int = LOCAL_ROWS) -> DataFrame:
    """``(id, depth, order_key)``: the place of each row in pre-order, from 0 in each project, as a long."""
    keys, tree = _tree_rows(tree)
    kind = tree.schema["id"].dataType.simpleString()
    rows, weights = _records(keys, tree, "ord", "depth")

    def local(table: pa.Table) -> pa.Table:
        up, _ = _parents(table)
        depth = table.column("depth").to_numpy()
        place = _positions(table, up, depth, _sizes(up, depth))
        return pa.table([table.column("project"), table.column("id"), table.column("depth"), pa.array(place)], ["project", "id", "depth", "order_key"])

    def far(large: DataFrame) -> DataFrame:
        names, tour = _toured(keys, tree, large)
        first = tour.groupBy("group").agg(F.min("position").alias("first"))
        own = tour.join(first, "group").select("id", "depth", (F.col("position") - F.col("first")).alias("order_key"))
        return names.name(own, "id").select(*keys, F.col("id").cast("string"), "depth", "order_key")

    found = bins.solve(rows, weights, _types(keys, tree), limit, local, "id string, depth bigint, order_key bigint", far, arrow=True)
    return found.withColumn("id", F.col("id").cast(kind))


def cycle_members(instances: DataFrame, limit: int = LOCAL_ROWS) -> DataFrame:
    """``(id)`` of every instance whose parent chain never ends."""
    keys, instances = _keyed(instances)
    kind = instances.schema["id"].dataType.simpleString()
    rows, weights = _records(keys, instances)

    def local(table: pa.Table) -> pa.Table:
        up, _ = _parents(table)
        endless, _, _ = _cycles(up, np.zeros(len(up), np.int64))
        return table.select(["project", "id"]).filter(pa.array(endless))

    def far(large: DataFrame) -> DataFrame:
        names, table = _numbered(keys, _only(instances, keys, large))
        found = jump_to_end(usable_parents(table.drop(*keys))).filter("cyclic").select("id")
        return names.name(found, "id").select(*keys, F.col("id").cast("string"))

    found = bins.solve(rows, weights, _types(keys, instances), limit, local, "id string", far, arrow=True)
    return found.withColumn("id", F.col("id").cast(kind))
