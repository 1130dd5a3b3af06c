"""Snippet location, block application, diffs and history on literal input."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import edits as E
from corpusgraph.operators import diffs as D
from corpusgraph.operators import history as H
from corpusgraph.operators import patches as A

FILE = "function a() {\n    const x = 1;\n\n    const y = 2;\n    return x + y;\n}\nconst z = f( a, b );\n"


def located(spark, content, find):
    frame = spark.createDataFrame([(content, find)], "content string, find string")
    return A.locate_snippets(frame).first()["m"]


@pytest.mark.parametrize("find, how", [
    ("const y = 2;", "exact"),
    ("> 4 |     const y = 2;\n> 5 |     return x + y;", "stripped"),
    ("    const y = 2;  \n    return x + y;", "trim_end"),
    ("const y = 2;\nreturn x + y;", "trim"),
    ("const z=f(a,b);", "collapsed"),
    ("const x = 1;\nconst y = 2;", "blank_lines"),
    ("function a() {\nconst y = 2;\nreturn x + y;", "boundary"),
])
def test_ladder(spark, find, how):
    match = located(spark, FILE, find)
    assert match.ok and match.how == how, match


def test_ladder_refusals(spark):
    assert located(spark, "x\nx\n", "x").reason == "matched 2 times"
    assert located(spark, " x\n y\n x\n y\n", "x\ny").reason == "matched 2 times"
    assert located(spark, FILE, "  \n").how == "empty"
    assert located(spark, FILE, "nothing like it").reason == "could not find exact FIND text"


def test_carriage_returns_survive(spark):
    match = located(spark, "a\r\n  b\r\nc\r\n", "a\nb")
    assert match.ok and match.target == "a\r\n  b"


def folded(spark, content, blocks):
    frame = spark.createDataFrame([(1, content, blocks)], "key int, base string, edits array<struct<find:string,replace:string>>")
    row = A.apply_blocks(frame).first()
    return row.content, [(r.status, r.how) for r in row.results]


def test_blocks_in_order(spark):
    text, states = folded(spark, "let one = 1;\nlet two = 2;\n", [("let one = 1;", "let one = 10;"), ("let two = 2;", "let two = $&;")])
    assert text == "let one = 10;\nlet two = $&;\n" and states == [("applied", "exact")] * 2


def test_undoing_block_is_refused(spark):
    _, states = folded(spark, "speed = 1;\n", [("speed = 1;", "speed = 2;"), ("speed = 2;", "speed = 1;")])
    assert states == [("applied", "exact"), ("failed", "overlap")]


def test_second_paste_is_already_applied(spark):
    _, states = folded(spark, "a\nnew text here\n", [("old text", "new text here")])
    assert states == [("already", "none")]


def test_layout_is_restored(spark):
    text, _ = folded(spark, "{\n  a();\n\n  b();\n}\n", [("a();\nb();", "c();\nd();")])
    assert text == "{\n  c();\n\n  d();\n}\n"


def brute_boundary(f, s):
    f, s = [x.strip() for x in f], [x.strip() for x in s]
    if len(s) < 3 or len(s[0]) < 4 or len(s[-1]) < 2:
        return []
    solid, spans = [x for x in s if x], []
    for j in range(len(f)):
        if f[j] != s[0]:
            continue
        for k in range(max(j + 2, j + len(s) - 4), min(len(f) - 1, j + len(s) + 4) + 1):
            if f[k] != s[-1]:
                continue
            rest = iter([x for x in f[j:k + 1] if x])
            if all(x in rest for x in solid):
                spans.append((j, k))
                break
    return spans


def test_boundary_anchor_against_brute_force(spark):
    rng = random.Random(3)
    words = ["open {", "body1", "body2", "", "close }"]
    data = []
    for n in range(60):
        f = [rng.choice(words) for _ in range(12)]
        data.append((n, f, ["open {", rng.choice(words), "close }"]))
    frame = spark.createDataFrame(data, "n int, f array<string>, s array<string>")
    got = {r.n: [(p.start, p.end) for p in r.v] for r in frame.select("n", E.boundary_anchor(F.col("f"), F.col("s")).alias("v")).collect()}
    assert got == {n: brute_boundary(f, s) for n, f, s in data}


def brute_diff(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    ops, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            ops.append(" " + a[i]); i += 1; j += 1
        elif j == m or (i < n and t[i + 1][j] >= t[i][j + 1]):
            ops.append("-" + a[i]); i += 1
        else:
            ops.append("+" + b[j]); j += 1
    return ops


def test_diff_against_brute_force(spark):
    rng = random.Random(5)
    data = [(n, [rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for n in range(60)]
    frame = spark.createDataFrame([(n, "\n".join(a), "\n".join(b)) for n, a, b in data], "n int, before string, after string")
    sign = {"context": " ", "delete": "-", "add": "+"}
    got = {r.n: [sign[o.type] + o.line for o in r.ops] for r in D.line_diff(frame).collect()}
    assert got == {n: brute_diff(a, b) for n, a, b in data}


def test_unified_diff_and_limit(spark):
    before = "\n".join(f"l{i}" for i in range(1, 13)) + "\n"
    after = before.replace("l2\n", "L2\n").replace("l12\n", "l12\nl13\n")
    frame = spark.createDataFrame([(before, after)], "before string, after string")
    text = D.render(D.line_diff(frame), F.lit("a.txt")).first()["diff"]
    assert text == ("--- a/a.txt\n+++ b/a.txt\n@@ -1,4 +1,4 @@\n l1\n-l2\n+L2\n l3\n l4\n@@ -11,2 +11,3 @@\n l11\n l12\n+l13\n")
    assert D.line_diff(frame, limit=5).first()["refused"]


def brute_history(actions, limit):
    undo, redo, out = [], [], []
    for number, action in actions:
        ok = True
        if action == "record":
            undo, redo = (undo + [number])[-limit:], []
        elif action == "undo" and undo:
            redo.append(undo.pop())
        elif action == "redo" and redo:
            undo.append(redo.pop())
        else:
            ok = False
        out.append((number, ok, len(undo), len(redo)))
    return out, undo, redo


def test_replay_over_many_buckets(spark):
    rng = random.Random(9)
    actions = [(n, rng.choice(["record", "record", "undo", "redo", "undo"])) for n in range(400)]
    frame = spark.createDataFrame([(7, n, n, a) for n, a in actions], "project long, event_id long, s long, action string").withColumn(
        "ts", F.timestamp_seconds("s")).drop("s")
    done = H.replay(frame, limit=5, bucket=F.lpad(F.floor(F.col("event_id") / 37).cast("string"), 4, "0"))
    want, undo, redo = brute_history(actions, 5)
    assert sorted((r.event_id, r.ok, r.undo_count, r.redo_count) for r in done.collect()) == want
    status = H.status(done).first()
    assert status.next_undo == (undo[-1] if undo else None) and status.next_redo == (redo[-1] if redo else None)
    assert status.recent == ",".join(map(str, undo[-5:]))
