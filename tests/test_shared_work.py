"""Work that many rows share is done once: stored extractions, one digest table, texts taken by number, slices of a batch."""

import hashlib
from collections import Counter

import pyarrow as pa

from corpusgraph.operators import diffs
from corpusgraph.operators import graph as G


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _graph(spark, nodes, edges):
    return (spark.createDataFrame(nodes, "id string, type string, engine string"), spark.createDataFrame(edges, "src string, dst string, kind string"))


def test_fingerprint_adds_the_lanes_of_all_digests(spark):
    nodes, edges = [("a", "m", "js"), ("a", "m", "js"), (None, "m", "js")], [("a", "b", "import")] * 3
    texts = ["|".join(x for x in ("n", *r) if x is not None) for r in nodes] + ["|".join(("e", *r)) for r in edges]
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    sums = [sum(int(d[8 * i:8 * i + 8], 16) for d in digests) for i in range(8)]
    want = (6, hashlib.sha256("|".join(map(str, sums)).encode()).hexdigest())
    assert tuple(G.fingerprint(*_graph(spark, nodes, edges)).first()) == want
    empty = G.fingerprint(*_graph(spark, [], [])).first()
    assert tuple(empty) == (0, hashlib.sha256(b"").hexdigest())


def test_same_graph_counts_what_one_side_has_more(spark):
    rows = lambda texts: spark.createDataFrame([(hashlib.sha256(x.encode()).hexdigest(),) for x in texts], "digest string")
    a, b = rows("xxxyyz"), rows("xyyww")
    both = {r.digest.hex(): r.n for r in G.in_both(a, b).collect()}
    name = {hashlib.sha256(x.encode()).hexdigest(): x for x in "xyzw"}
    assert {name[k]: n for k, n in both.items()} == dict(Counter("xxxyyz") & Counter("xyyww"))
    found = {(name[r.digest], r.side): r.n for r in G.same_graph(G.tally(a), G.tally(b)).collect()}
    assert found == {("x", "left"): 2, ("z", "left"): 1, ("w", "right"): 2}


def test_neighbourhood_reads_no_project_text_per_pair(spark):
    nodes = spark.createDataFrame([(p, x) for p in (7, 8) for x in "abcd"] + [(None, "a"), (7, None)], "project long, id string")
    edges = spark.createDataFrame([(p, s, d, "k") for p in (7, 8) for s, d in ("ab", "bc", "cd", "aa", "xb")], "project long, src string, dst string, kind string")
    near = G.neighbourhood(nodes, edges, nodes, 2)
    assert "from_json" not in _plan(near) and dict(near.dtypes)["project"] == "bigint"
    want = {(p, f, i, abs(ord(f) - ord(i))) for p in (7, 8) for f in "abcd" for i in "abcd" if abs(ord(f) - ord(i)) <= 2}
    assert set(map(tuple, near.collect())) == want == set(map(tuple, G.neighbourhood(nodes, edges, nodes, 2, limit=0).collect()))


def test_walks_of_a_batch_are_made_in_slices():
    texts = [([str(k % 7), "a", "b"], ["a", str(k % 5), "b"]) for k in range(2 * diffs.SLICE + 3)] + [([], []), (["x"], [])]
    before, after = (pa.array([t[k] for t in texts], pa.list_(pa.string())) for k in (0, 1))
    got = diffs._operations(before, after)
    assert [[tuple(op.values()) for op in ops] for ops in got.to_pylist()] == [diffs._walk(*t) for t in texts]
    assert diffs._operations(before.slice(0, 0), after.slice(0, 0)).to_pylist() == []
