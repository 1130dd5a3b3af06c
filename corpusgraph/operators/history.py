"""Change history: steps, retention, undo / redo replay, status, conflicts."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import paths as P
from corpusgraph.plans.dense import placed
from corpusgraph.plans.loops import cut
from corpusgraph.sources.files import top_per_group


def numbered_in_order(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``name``: 1, 2, ... per key in order, nulls first; places come from ranges, so no key is one task."""
    whole = placed(rows, [F.col(c).asc_nulls_first() for c in (key, *order)], "_place")
    firsts = whole.groupBy(key).agg(F.min("_place").alias("_first"))
    return _same(whole, firsts, key).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def record_steps(log: DataFrame) -> DataFrame:
    """Number the changing rows of ``(project, event_id, ts, path, before, after)`` per project.

    Rows that change nothing are no steps. Adds ``step``, ``patch_id``, ``description``.
    """
    changed = log.filter(~F.col("before").eqNullSafe(F.col("after")))
    steps = numbered_in_order(changed, "project", ["ts", "event_id"], "step")
    number = F.when(F.col("step") < 1000, F.lpad(F.col("step").cast("string"), 3, "0")).otherwise(F.col("step").cast("string"))
    described = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("Modified 1 file")) if (
        "description" in log.columns) else F.lit("Modified 1 file")
    return steps.withColumn("patch_id", F.concat(F.lit("PATCH #"), number)).withColumn("description", described)


def newest(steps: DataFrame, limit: int) -> DataFrame:
    """The last steps per project, newest first in ``rn``."""
    return top_per_group(steps, ["project"], [F.col("ts").desc(), F.col("event_id").desc()], limit)


def retained(steps: DataFrame, limit: int) -> DataFrame:
    return newest(steps, limit)


def recent_keys(log: DataFrame, key: str, limit: int) -> DataFrame:
    """Most recent distinct keys per project."""
    last = log.groupBy("project", key).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return top_per_group(last, ["project"], [F.col("last").desc()], limit).select("project", key, "rn")


def describe_steps(changes: DataFrame, shown: int) -> DataFrame:
    """``(step, description)``: the first files by path, and how many more."""
    counts = changes.groupBy("step").agg(F.count("*").alias("n"))
    first = top_per_group(changes.select("step", "path"), ["step"], [F.col("path")], shown).groupBy("step").agg(
        F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("files"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" +"), F.col("n") - shown, F.lit(" more"))).otherwise("")
    return counts.join(first, "step").select("step", F.concat(F.lit("Patch: "), "files", more).alias("description"))


def describe_edit(op: Column, instance: Column, prefab: Column) -> Column:
    return (
        F.when(op == "setTransform", F.concat(F.lit("Move "), instance))
        .when(op == "swapModel", F.concat(F.lit("Swap model of "), instance))
        .when(op == "addInstance", F.concat(F.lit("Add "), prefab, F.lit(' "'), instance, F.lit('"')))
        .when(op == "removeInstance", F.concat(F.lit("Remove "), instance))
        .when(op == "setParams", F.concat(F.lit("Set params of "), instance))
        .otherwise("Scene edit")
    )


def clear(history: DataFrame, projects: DataFrame) -> DataFrame:
    """Drop all rows of the named projects; keys are compared in normal form."""
    gone = projects.select(P.normalize_project_key(F.col("project")).alias("_k")).distinct()
    return history.withColumn("_k", P.normalize_project_key(F.col("project"))).join(gone, "_k", "left_anti").drop("_k")


# --- undo / redo -------------------------------------------------------------
# A project's state is how deep its undo and redo stacks are, so a run of actions is a function on few states. All
# actions stand in one sequence, by project and time, in which a project's first action starts from empty
# stacks. The sequence is cut into blocks of equal size whatever the projects; blocks become functions in parallel,
# functions are chained in groups, groups of groups, and so on, and each block is replayed from its known start.

#: Rows of a block, rows that a block steps through at once, and functions that are chained at once.
BLOCK_ROWS = 65_536
PIECE_ROWS = 256
CHAIN = 256
_OTHER = 3


def _states(limit: int) -> list[tuple[int, int]]:
    return [(u, r) for u in range(limit + 1) for r in range(limit + 1 - u)]


def _moves(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Next state per action and state, and whether the oldest step falls off. Other actions change nothing."""
    states = _states(limit)
    at = {s: i for i, s in enumerate(states)}
    follow = np.tile(np.arange(len(states), dtype=np.int32), (4, 1))
    drops = np.zeros((4, len(states)), dtype=np.int64)
    for i, (u, r) in enumerate(states):
        follow[0, i], drops[0, i] = at[min(u + 1, limit), 0], int(u == limit)
        follow[1, i] = at[u - 1, r + 1] if u else i
        follow[2, i] = at[u + 1, r - 1] if r else i
    return follow, drops


def _pieces(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and starts of projects, a row per piece; the last one is filled with actions that change nothing."""
    n = len(frame)
    wide = -(-n // PIECE_ROWS) * PIECE_ROWS
    codes, opens = np.full(wide, _OTHER, np.int64), np.zeros(wide, bool)
    codes[:n], opens[:n] = frame["code"], frame["opens"]
    return codes.reshape(-1, PIECE_ROWS), opens.reshape(-1, PIECE_ROWS)


def _functions(codes, opens, follow, drops):
    """Per piece: the end of every state, what fell off on the way, and whether a project began in it."""
    ends = np.tile(np.arange(follow.shape[1], dtype=np.int32), (len(codes), 1))
    lost = np.zeros(ends.shape, np.int64)
    for k in range(PIECE_ROWS):
        begins = opens[:, k, None]
        ends, lost = np.where(begins, 0, ends), np.where(begins, 0, lost)
        code = codes[:, k, None]
        lost += drops[code, ends]
        ends = follow[code, ends]
    return ends, lost, opens.any(axis=1)


def _after(first, then):
    """The function that applies ``first``, then ``then``; each is ``(ends, lost, fresh)``."""
    ends, lost, fresh = first
    more = then[1][ends]
    return then[0][ends], more if then[2] else lost + more, fresh or then[2]


def _functions_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.sort_values("block")
    return [(b, (np.asarray(e), np.asarray(l), f)) for b, e, l, f in zip(frame["block"], frame["ends"], frame["lost"], frame["fresh"])]


def _starts(functions: list[tuple], state: int, lost: int) -> pd.DataFrame:
    rows = []
    for block, (ends, gone, fresh) in functions:
        rows.append((block, state, lost))
        state, lost = int(ends[state]), int(gone[state] + (0 if fresh else lost))
    return pd.DataFrame(rows, columns=["block", "start", "start_lost"])


_FUNCTION = "block bigint, ends array<int>, lost array<bigint>, fresh boolean"
_START = "block bigint, start int, start_lost bigint"


def _block_starts(functions: DataFrame, chain: int) -> DataFrame:
    """``(block, start, start_lost)``: the state in which each block begins."""
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        known = _functions_of(frame)
        ends, lost, fresh = reduce(_after, [f for _, f in known])
        return pd.DataFrame({"block": [known[0][0] // chain], "ends": [ends], "lost": [lost], "fresh": [bool(fresh)]})

    levels, count = [functions], functions.count()
    while count > chain:
        levels.append(cut(levels[-1].withColumn("group", F.expr(f"block div {chain}")).groupBy("group").applyInPandas(
            lambda frame: join(frame), _FUNCTION)))
        count = -(-count // chain)
    starts = levels[-1].groupBy().applyInPandas(lambda frame: _starts(_functions_of(frame), 0, 0), _START)

    def down(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return _starts(_functions_of(frame), int(above["start"].iloc[0]), int(above["start_lost"].iloc[0]))

    for level in reversed(levels[:-1]):
        grouped = level.withColumn("group", F.expr(f"block div {chain}")).groupBy("group")
        starts = cut(grouped.cogroup(starts.withColumnRenamed("block", "group").groupBy("group")).applyInPandas(
            lambda frame, above: down(frame, above), _START))
    return starts


def replay(actions: DataFrame, limit: int, bucket: Column | None = None, block_rows: int = BLOCK_ROWS,
           chain: int = CHAIN) -> DataFrame:
    """``(project, event_id, ts, action, ok, undo_count, redo_count, dropped)`` per action.

    ``ok`` is false for an undo or redo on an empty stack, and for an action of another name, which does nothing. ``dropped``
    counts the steps that retention has removed so far. A null project is a project of its own; a null time comes first.
    Blocks have ``block_rows`` rows and ``chain`` of them are chained at once; ``bucket`` has no effect any more.
    """
    follow, drops = _moves(limit)
    depths = np.array(_states(limit))
    coded = F.when(F.col("action") == "record", 0).when(F.col("action") == "undo", 1).when(F.col("action") == "redo", 2).otherwise(_OTHER)
    rows = placed(actions.select("project", "event_id", "ts", "action", coded.cast("int").alias("code")),
                  [F.col(c).asc_nulls_first() for c in ("project", "ts", "event_id")])
    firsts = rows.groupBy("project").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("opens"))
    rows = cut(rows.join(firsts, "position", "left").withColumn("opens", F.coalesce("opens", F.lit(False))).withColumn(
        "block", F.expr(f"position div {block_rows}")))

    def function(frame: pd.DataFrame) -> pd.DataFrame:
        codes, opens = _pieces(frame.sort_values("position"))
        ends, lost, fresh = reduce(_after, zip(*_functions(codes, opens, follow, drops)))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "ends": [ends], "lost": [lost], "fresh": [bool(fresh)]})

    functions = cut(rows.select("block", "position", "code", "opens").groupBy("block").applyInPandas(function, _FUNCTION))
    starts = cut(_block_starts(functions, chain))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        codes, opens = _pieces(frame)
        known = list(enumerate(zip(*_functions(codes, opens, follow, drops))))
        begin = _starts(known, int(frame["start"].iloc[0]), int(frame["start_lost"].iloc[0]))
        state, lost = begin["start"].to_numpy(np.int64), begin["start_lost"].to_numpy(np.int64)
        after, gone, moved = (np.zeros(codes.shape, kind) for kind in (np.int64, np.int64, bool))
        for k in range(PIECE_ROWS):  # all pieces one action on
            state, lost, code = np.where(opens[:, k], 0, state), np.where(opens[:, k], 0, lost), codes[:, k]
            new = follow[code, state]
            lost = lost + drops[code, state]
            moved[:, k] = (code == 0) | (new != state)
            after[:, k], gone[:, k], state = new, lost, new
        n = len(frame)
        depth = depths[after.ravel()[:n]]
        return pd.DataFrame({"position": frame["position"], "ok": moved.ravel()[:n], "undo_count": depth[:, 0].astype(np.int32),
                             "redo_count": depth[:, 1].astype(np.int32), "dropped": gone.ravel()[:n]})

    done = rows.select("block", "position", "code", "opens").join(starts, "block").groupBy("block").applyInPandas(
        run, "position bigint, ok boolean, undo_count int, redo_count int, dropped bigint")
    return rows.select("position", "project", "event_id", "ts", "action").join(done, "position").drop("position")


def _same(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that may be null; null meets null."""
    other = right.withColumnRenamed(key, "_other")
    return left.join(other, F.col(key).eqNullSafe(F.col("_other")), how).drop("_other")


def status(replayed: DataFrame, recent: int = K.RECENT_LIMIT) -> DataFrame:
    """Per project: stack depths, what undo and redo would touch, the last steps.

    A step sits at height ``undo depth + dropped`` when recorded. The entry at a height
    is the latest record made there, so the stacks are read off without replaying.
    """
    replayed = cut(replayed)
    when = F.struct("ts", "event_id")
    now = replayed.groupBy("project").agg(F.max_by(F.struct("undo_count", "redo_count", "dropped"), when).alias("s")).select(
        "project", "s.undo_count", "s.redo_count", (F.col("s.dropped") + F.col("s.undo_count")).alias("top"))
    held = replayed.filter("action = 'record'").groupBy(
        "project", (F.col("undo_count") + F.col("dropped")).alias("height")).agg(F.max_by("event_id", when).alias("step"))
    near = _same(held, now, "project").filter((F.col("height") <= F.col("top") + 1) & (F.col("height") > F.col("top") - recent))
    listed = near.groupBy("project").agg(
        F.max(F.when((F.col("height") == F.col("top")) & (F.col("undo_count") > 0), F.col("step"))).alias("next_undo"),
        F.max(F.when((F.col("height") == F.col("top") + 1) & (F.col("redo_count") > 0), F.col("step"))).alias("next_redo"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            (F.col("height") <= F.col("top")) & (F.col("height") > F.col("top") - F.least("undo_count", F.lit(recent))),
            F.struct("height", "step")))), lambda h: h["step"].cast("string")), ",").alias("recent"))
    return _same(now, listed, "project", "left").select(
        "project", (F.col("undo_count") > 0).alias("can_undo"), (F.col("redo_count") > 0).alias("can_redo"),
        "undo_count", "redo_count", "next_undo", "next_redo", F.coalesce("recent", F.lit("")).alias("recent"))


# --- images ------------------------------------------------------------------

def state_as_of(steps: DataFrame, step: int) -> DataFrame:
    """``(project, path, content)`` after that many steps; absent files are left out."""
    last = steps.filter(F.col("step") <= step).groupBy("project", "path").agg(
        F.max_by(F.struct("after"), "step").alias("s"))
    return last.select("project", "path", F.col("s.after").alias("content")).filter("content IS NOT NULL")


def conflicts(steps: DataFrame, files: DataFrame, expected: str = "after") -> DataFrame:
    """``(project, step, path)`` where the current content is not what the step recorded."""
    current = files.select("project", "path", F.col("content").alias("current"))
    joined = steps.join(current, ["project", "path"], "left")
    return joined.filter(~F.col("current").eqNullSafe(F.col(expected))).select("project", "step", "path")
