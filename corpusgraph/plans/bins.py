"""Graphs of many projects, solved whole projects at a time where they are small.

A project of at most ``limit`` weight meets others in a bin; a task takes a bin and solves its
graphs in memory with arrays. Projects above the limit go through loops over the cluster.
Both give the same rows.
"""

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.loops import cut_counting

LINK, NODE, SEED = 0, 1, 2
RECORD = ["project", "kind", "a", "b"]


def records(keys: list[str], kind: int, frame: DataFrame, a: str, b: str | None = None) -> DataFrame:
    """Rows of one kind for a bin: project and ids as text. Rows with a null project or id go."""
    project = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = (frame.dropna(subset=keys) if keys else frame).select(project.alias("project"), F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"),
                        (F.col(b).cast("string") if b else F.lit(None).cast("string")).alias("b"))
    return rows.filter("a IS NOT NULL AND b IS NOT NULL" if kind == LINK else "a IS NOT NULL").distinct()


#: Types of project columns that JSON holds as they are.
_PLAIN = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _keyed(local: Callable, keys: dict[str, str]) -> Callable:
    """``local`` with the project's columns in place of its text, which is parsed once per project and not once per row."""
    def run(table: pa.Table) -> pa.Table:
        solved = local(table)
        text = solved.column("project").combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        text = text.dictionary_encode()
        parsed = [json.loads(x) if x else {} for x in text.dictionary.to_pylist()]
        columns = [pa.array([p.get(k) for p in parsed], _PLAIN[kind]).take(text.indices) for k, kind in keys.items()]
        rest = [n for n in solved.column_names if n != "project"]
        return pa.table([*columns, *[solved.column(n) for n in rest]], [*keys, *rest])
    return run


def solve(rows: DataFrame, weights: DataFrame, keys: dict[str, str], limit: int, local: Callable, schema: str,
          far: Callable[[DataFrame], DataFrame], arrow: bool = False) -> DataFrame:
    """``local`` over the small projects' records, ``far`` for the others.

    ``weights (project, weight)`` says how much of a task a project takes; ``keys`` gives the project columns' types.
    ``local`` takes the records of a bin as a pandas frame (an Arrow table with ``arrow``) and returns ``project`` and the
    columns of ``schema``.
    ``far`` is given the table of large projects, ``(project)``, and returns the key columns and those of ``schema``.
    """
    weights, counts = cut_counting(weights, large=F.col("weight") > limit)
    total = weights.filter(F.col("weight") <= limit).agg(F.sum("weight").alias("n")).first()["n"] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = max(-(-int(total) // max(limit, 1)), least)
    large = weights.filter(F.col("weight") > limit).select("project")
    result = None
    if counts["rows"] > counts["large"] or not counts["rows"]:
        small = rows.join(large, "project", "left_anti") if counts["large"] else rows
        dealt = small.withColumn("bin", F.pmod(F.xxhash64("project"), F.lit(bins))).groupBy("bin")
        plain = arrow and all(kind in _PLAIN for kind in keys.values())
        apply = dealt.applyInArrow if arrow else dealt.applyInPandas
        solved = apply(_keyed(local, keys) if plain else lambda table: local(table), ", ".join(
            [f"`{k}` {kind}" for k, kind in keys.items()] + [schema]) if plain else f"project string, {schema}")
        named = list(keys) if plain else [F.from_json("project", ", ".join(f"`{k}` {kind}" for k, kind in keys.items()))[k].alias(k) for k in keys]
        result = solved.select(*named, *[c.split()[0] for c in schema.split(", ")])
    if counts["large"]:
        others = far(large)
        result = others if result is None else result.unionByName(others)
    return result


class Bin:
    """The graphs of a bin with nodes numbered by project and id, so that the least number is the least id."""

    def __init__(self, frame: pd.DataFrame):
        kind = frame["kind"].to_numpy()
        link = kind == LINK
        project, projects = pd.factorize(frame["project"], sort=True)
        ids, names = pd.factorize(pd.concat([frame["a"], frame["b"][link]], ignore_index=True), sort=True)
        key = np.concatenate([project, project[link]]) * np.int64(max(len(names), 1)) + ids
        known, number = np.unique(key, return_inverse=True)
        self.n, self.links = len(known), link
        self.project, self.id = projects.to_numpy()[known // max(len(names), 1)], names.to_numpy()[known % max(len(names), 1)]
        #: first node of the project of each node
        self.first = np.searchsorted(known // max(len(names), 1), known // max(len(names), 1), "left")
        a, b = number[:len(frame)], number[len(frame):]
        self.src, self.dst = a[link], b
        self.a, self.kind, self.b = a, kind, frame["b"].to_numpy()

    def of_kind(self, kind: int) -> np.ndarray:
        return self.a[self.kind == kind]

    def is_node(self) -> np.ndarray:
        mask = np.zeros(self.n, bool)
        mask[self.of_kind(NODE)] = True
        return mask


def lists(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists: where each node's begins, and the neighbours."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def around(nodes: np.ndarray, starts: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All neighbours of ``nodes``, and per neighbour the place in ``nodes`` that it belongs to."""
    begin, counts = starts[nodes], starts[nodes + 1] - starts[nodes]
    ends = np.cumsum(counts)
    at = np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    return targets[at], np.repeat(np.arange(len(nodes)), counts)


def groups(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, int]:
    """Strongly connected groups (depth first, without recursion): a number per node, and how many.

    A group's number is above those of all groups that it reaches.
    """
    starts, targets = (x.tolist() for x in lists(n, src, dst))
    index, low, group, stack, seen, made = [-1] * n, [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = seen
        seen += 1
        stack.append(root)
        path = [(root, starts[root])]
        while path:
            node, at = path[-1]
            if at < starts[node + 1]:
                path[-1] = (node, at + 1)
                other = targets[at]
                if index[other] < 0:
                    index[other] = low[other] = seen
                    seen += 1
                    stack.append(other)
                    path.append((other, starts[other]))
                elif group[other] < 0:
                    low[node] = min(low[node], index[other])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[node])
            if low[node] == index[node]:
                while True:
                    member = stack.pop()
                    group[member] = made
                    if member == node:
                        break
                made += 1
    return np.array(group, np.int64), made


def reach_pairs(b: Bin, src: np.ndarray, dst: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(seed, node)``: all that each seed reaches, itself included; one bit per node of the project and group."""
    group, made = groups(b.n, src, dst)
    starts, targets = lists(made, group[src], group[dst])
    members = [0] * made
    for node, (g, first) in enumerate(zip(group.tolist(), b.first.tolist())):
        members[g] |= 1 << (node - first)
    starts, targets = starts.tolist(), targets.tolist()
    for g in range(made):  # all that a group reaches has a lower number
        bits = members[g]
        for other in set(targets[starts[g]:starts[g + 1]]):
            if other != g:
                bits |= members[other]
        members[g] = bits
    found, counts = [], []
    for seed in seeds.tolist():
        bits = members[group[seed]]
        raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
        found.append(np.flatnonzero(np.unpackbits(raw, bitorder="little")) + b.first[seed])
        counts.append(len(found[-1]))
    return np.repeat(seeds, counts), np.concatenate(found) if found else np.zeros(0, np.int64)


def layer_numbers(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """0 without dependencies, else one more than the deepest; -1 on or above a cycle."""
    starts, above = lists(n, dst, src)
    open_, layer = np.bincount(src, minlength=n), np.full(n, -1, np.int64)
    ready, number = np.flatnonzero(open_ == 0), 0
    while len(ready):
        layer[ready] = number
        touched, times = np.unique(around(ready, starts, above)[0], return_counts=True)
        open_[touched] -= times
        ready = touched[open_[touched] == 0]
        number += 1
    return layer
