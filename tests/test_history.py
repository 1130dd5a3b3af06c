"""Undo and redo over blocks against plain stacks; long diffs."""

import datetime
import random
import time

import pytest

from corpusgraph.operators import diffs
from corpusgraph.operators import history as H


def plain_replay(rows, limit):
    out, stacks = {}, {}
    key = lambda r: (r[2] is not None, r[2] or datetime.datetime.min, r[1])
    for project in {r[0] for r in rows}:
        undo, redo, dropped = [], [], 0
        for r in sorted((r for r in rows if r[0] == project), key=key):
            ok = True
            if r[3] == "record":
                undo, redo = undo + [r[1]], []
                if len(undo) > limit:
                    undo, dropped = undo[1:], dropped + 1
            elif r[3] == "undo" and undo:
                redo.append(undo.pop())
            elif r[3] == "redo" and redo:
                undo.append(redo.pop())
            else:
                ok = False
            out[r[1]] = (ok, len(undo), len(redo), dropped)
        stacks[project] = (undo, redo)
    return out, stacks


def actions(seed=5):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.05 else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(400))
    kinds = ["record"] * 5 + ["undo"] * 4 + ["redo"] * 3 + [None, "other"]
    projects = [7] * 20 + [1, 2, 3, None, None]
    return [(rng.choice(projects), k, when(), rng.choice(kinds)) for k in range(1500)]


@pytest.mark.parametrize("block_rows, chain", [(H.BLOCK_ROWS, H.CHAIN), (60, 3)])
def test_replay_equals_plain_stacks(spark, block_rows, chain):
    rows = actions()
    table = spark.createDataFrame(rows, "project long, event_id long, ts timestamp, action string").repartition(5)
    want, stacks = plain_replay(rows, 4)
    done = H.replay(table, 4, block_rows=block_rows, chain=chain)
    got = {r.event_id: (r.ok, r.undo_count, r.redo_count, r.dropped) for r in done.collect()}
    assert got == want
    status = {r.project: r for r in H.status(done).collect()}
    assert status.keys() == stacks.keys()
    for project, (undo, redo) in stacks.items():
        r = status[project]
        assert (r.next_undo, r.next_redo) == (undo[-1] if undo else None, redo[-1] if redo else None)
        assert r.recent == ",".join(map(str, undo[-5:]))


def test_replay_of_nothing(spark):
    assert H.replay(spark.createDataFrame([], "project long, event_id long, ts timestamp, action string"), 5).collect() == []


def table_walk(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("context", a[i], i + 1, j + 1))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(("delete", a[i], i + 1, None))
            i += 1
        else:
            out.append(("add", b[j], None, j + 1))
            j += 1
    return out


def test_bit_rows_walk_like_the_whole_table():
    rng = random.Random(2)
    for _ in range(800):
        letters = "abcdefgh"[:rng.choice([1, 2, 3, 8])]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(40))] for _ in range(2))
        assert diffs._walk(a, b) == table_walk(a, b)


def test_long_versions_are_compared_in_seconds():
    rng = random.Random(3)
    before = [rng.choice(["}", "", f"line {k}"]) for k in range(40_000)]
    after = list(before)
    for _ in range(4_000):
        after[rng.randrange(len(after))] = f"new {rng.random()}"
    del after[100:150]
    begin = time.perf_counter()
    ops = diffs._walk(before, after)
    assert time.perf_counter() - begin < 30
    assert [x[1] for x in ops if x[0] != "add"] == before and [x[1] for x in ops if x[0] != "delete"] == after
