"""Merkle trees over whole tables: leaves, roots, proofs and their check.

Every group (a language, say) is a tree of its rows in order; the groups' roots, in order, are
the leaves of the tree above. While a tree has several nodes on a level, each run of eight (the
last may be shorter) becomes their digest, the SHA-256 of the nodes as hexadecimal text.

A superblock is 4,096 consecutive nodes of a tree, the run of eight four times over. One
task reduces a superblock to its top node, and those are the nodes of the next tier. On the way down
each superblock is grouped with the one row that it needs from outside, the siblings of its top
node up to the root, and the same task finishes the inner levels, joins the proofs and folds them.
"""

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.order import ranged, with_running_sum
from corpusgraph.plans.loops import cut
from corpusgraph.plans.numbering import running_number

FANOUT = 8
#: Levels inside a superblock.
LEVELS = 4
OUTER = "tree long, block long, proof string"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf(*columns: str | Column) -> Column:
    """Digest of a row: each value as its byte count, a colon and its text; ``-`` for null."""
    def one(column):
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in columns]), 256)


def reduce_nodes(nodes: list[str], several: bool, levels: int = LEVELS) -> list[list[str]]:
    """The levels above ``nodes`` inside one superblock, ``nodes`` first.

    With ``several`` superblocks in the tree all ``levels`` are built, since nodes remain beside these.
    """
    built = [nodes]
    while len(built) <= levels and (several or len(built[-1]) > 1):
        now = built[-1]
        built.append([digest(now[k:k + FANOUT]) for k in range(0, len(now), FANOUT)])
    return built


def inner_proof(levels: list[list[str]], place: int) -> list[tuple[int, list[str]]]:
    """Per level the node's place in its run, and the run's other nodes from left to right."""
    out = []
    for nodes in levels[:-1]:
        first = place // FANOUT * FANOUT
        run = nodes[first:first + FANOUT]
        out.append((place - first, run[:place - first] + run[place - first + 1:]))
        place //= FANOUT
    return out


def fold(node: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its proof give."""
    for place, others in proof:
        node = digest([*others[:place], node, *others[place:]])
    return node


def _tops(levels: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame.sort_values("place")
        top = reduce_nodes(nodes["node"].tolist(), bool(nodes["several"].iloc[0]), levels)[-1]
        return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "place": nodes["block"].iloc[:1], "node": top})
    return run


def _proofs(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> list[list[tuple[int, list[str]]]]:
    """Of each of the nodes of a superblock, in order: the inner siblings, then those from outside."""
    built = reduce_nodes(nodes["node"].tolist(), bool(nodes["several"].iloc[0]), levels)
    above = json.loads(outer["proof"].iloc[0]) if len(outer) else []
    return [inner_proof(built, k) + above for k in range(len(nodes))]


def _spread(levels: int):
    """Each node's own proof as the row that its superblock in the tier below needs."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        proofs = [json.dumps(p) for p in _proofs(nodes, outer, levels)]
        return pd.DataFrame({"tree": nodes["tree"], "block": nodes["place"], "proof": proofs})
    return run


def _finish(levels: int, whole: bool):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("place")
        proofs = _proofs(leaves, outer, levels)
        out = leaves[["id", "tree", "node"]].rename(columns={"node": "leaf"})
        out["proof_sha256"] = [digest(x for _, others in p for x in others) for p in proofs]
        out["folded_root"] = [fold(node, p) for node, p in zip(leaves["found"], proofs)]
        if whole:
            out["proof"] = [[{"place": a, "others": b} for a, b in p] for p in proofs]
        return out
    return run


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The tiers of ``(tree, place, node, ...)``, the given one first, until every tree is one node.

    All but the last know each node's superblock, and whether its tree has several.
    """
    tiers, size = [], FANOUT ** levels
    while True:
        counts = cut(nodes.groupBy("tree").agg(F.count("*").alias("nodes")))  # its written size tells the planner how to join
        tiers.append(cut(nodes.join(counts, "tree").withColumn("block", F.floor(F.col("place") / size).cast("long")).withColumn(
            "several", F.col("nodes") > size).drop("nodes")))
        nodes = cut(tiers[-1].select("tree", "place", "node", "block", "several").groupBy("tree", "block").applyInPandas(
            _tops(levels), "tree long, place long, node string"))
        if nodes.filter("place > 0").limit(1).count() == 0:
            return [*tiers, nodes]


def _blocks(rows: DataFrame):
    return rows.groupBy("tree", "block")


def _down(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """``(tree, block, proof)``: what the superblocks of the lowest tier need from outside, given that of the highest."""
    for tier in reversed(tiers[1:-1]):
        nodes = tier.select("tree", "block", "place", "node", "several")
        above = cut(_blocks(nodes).cogroup(_blocks(above)).applyInPandas(_spread(levels), OUTER))
    return above


def manifest(rows: DataFrame, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of ``rows (id, group, leaf, found)``.

    ``leaf`` is a row's digest and ``found`` the digest that is to be checked against the root (see :func:`leaf`).
    Rows are in order of their id inside their group, groups in bytewise order of their names, null
    first in both. Equal ids are in order of their leaves; rows that are equal in those are
    interchangeable. ``subroot`` is the root of the row's group, a lone row's its leaf; a lone group's is the
    root. ``proof_sha256`` is the digest of all siblings from the leaf to the root, ``folded_root`` what
    ``found`` gives with them. With ``proofs`` the siblings come as well: ``proof``, an array of
    ``(place, others)`` per level. Superblocks are ``8 ** levels`` nodes. Empty tables give no rows.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first()]
    hashed = cut(rows.select("id", "group", "leaf", "found"))  # finding the ranges reads the rows once more
    placed = running_number(ranged(hashed, order), ["group"], F.col("_part"), [*order[1:], F.col("leaf")], "number").drop("_part")
    groups = placed.groupBy("group").agg(F.count("*").alias("nodes"))
    trees = cut(with_running_sum(groups, [F.col("group").asc_nulls_first()], F.lit(1).cast("long"), "tree"))
    leaves = placed.join(trees.select(F.col("group").alias("_group"), "tree"), F.col("group").eqNullSafe(F.col("_group"))).select(
        F.col("id").cast("string").alias("id"), "tree", (F.col("number") - 1).alias("place"), F.col("leaf").alias("node"), "found")
    tiers = _climb(leaves, levels)
    subroots = tiers[-1].select("tree", F.col("node").alias("subroot"))
    top = _climb(tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "node"), levels)
    outer = _down([top[0], *top], spark.createDataFrame([], OUTER), levels)  # of the groups' roots, named by group
    outer = _down(tiers, outer.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "proof"), levels)
    schema = "id string, tree long, leaf string, proof_sha256 string, folded_root string"
    if proofs:
        schema += ", proof array<struct<place:long,others:array<string>>>"
    checked = _blocks(tiers[0]).cogroup(_blocks(outer)).applyInPandas(_finish(levels, proofs), schema)
    root = top[-1].first()  # one row, none where there are no rows
    named = checked.join(subroots, "tree").withColumn("root", F.lit(root["node"] if root else None).cast("string"))
    columns = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["proof"] * proofs
    return named.withColumn("id", F.col("id").cast(kind)).select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))
