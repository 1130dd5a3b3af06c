"""Joins of two large sides stay shuffles, however small the planner takes compressed or exploded rows to be."""

import json
import re

from pyspark.sql import functions as F

from corpusgraph.functions import documents
from corpusgraph.operators import context, hierarchy, ranking, validation
from corpusgraph.plans import loops
from corpusgraph.sources import declared, scenes


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_duplicate_ids_reads_the_documents_once_and_joins_nothing(spark):
    docs = [(1, [{"id": "a"}, {"id": "b"}, {"id": "a"}, {"id": "a"}]), (2, [{"id": "a"}, {}, {}]), (None, [{"id": "a"}, {"id": "a"}])]
    rows = spark.createDataFrame([(s, json.dumps({"instances": i})) for s, i in docs], "scene long, doc string")
    found = validation.duplicate_ids(scenes.instances(rows), "instances")
    assert "Join" not in _plan(found)
    text = 'duplicate id "a" — first defined at instances[0]'
    assert sorted(map(tuple, found.collect())) == [(1, "instances[2].id", text), (1, "instances[3].id", text)]


def test_loops_never_broadcast_a_side_that_grows(spark, monkeypatch):
    plans, plain = [], loops.cut_counting

    def watched(frame, **conditions):
        plans.append(_plan(frame))
        return plain(frame, **conditions)

    monkeypatch.setattr(loops, "cut_counting", watched)
    chain = spark.range(300).select("id", F.expr("CASE WHEN id % 100 > 0 THEN id - 1 WHEN id = 200 THEN 299 END").alias("parent"))
    found = loops.jump_to_end(chain)
    assert sum("Join" in p for p in plans) >= 5 and not any("Broadcast" in p for p in [*plans, _plan(found)])
    ended = {r.id: (r.root, r.steps) for r in found.filter("NOT cyclic").collect()}
    assert ended == {k: (k // 100 * 100, k % 100) for k in range(200)}
    assert found.filter("on_cycle").count() == 100


def test_hierarchy_jobs_of_large_projects_send_no_table_to_the_driver(spark):
    tree = spark.createDataFrame([(k, None if k == 0 else k // 3, f"n{k}", "p", 0) for k in range(40)], "id long, parent long, name string, prefab string, ord long")
    built = hierarchy.build_tree(tree.drop("ord"), limit=1)
    plan = _plan(hierarchy.subtree_sizes(built, limit=1))
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_declared_slots_join_by_key(spark):
    assets = spark.createDataFrame([("models/a.glb",), ("models/b.glb",)], "path string")
    entries = spark.createDataFrame([(0, "models/a.glb", '{"slot":"x"}')], "registry_rank int, key string, value string")
    found = declared.registry_slots(assets, entries)
    assert "Broadcast" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [("models/a.glb", '{"slot":"x"}'), ("models/b.glb", None)]


def test_words_meet_paths_directly_in_small_projects_and_by_pieces_in_large_ones(spark):
    files = spark.createDataFrame([(p, f"src/{d}/{k}.js") for p in (1, 2) for d in ("low", "High") for k in range(12)] + [(None, "src/a.js"), (1, None)],
                                  "project long, path string")
    words = spark.createDataFrame([(p, w) for p in (1, 2, 3) for w in ("high", "1.js", "src", "none")] + [(1, "low"), (None, "src")],
                                  "project long, word string")
    rows = lambda pairs: sorted(map(tuple, ranking.paths_with(words, files, pairs=pairs).collect()))
    want = sorted((p, w, f) for p, f in map(tuple, files.dropna().collect()) for q, w in map(tuple, words.dropna().collect())
                  if p == q and w in f.lower())
    for pairs in (0, 110, 10**6):
        assert rows(pairs) == want
    assert "Generate" not in _plan(ranking.paths_with(words, files))


def _ranking_tables(spark):
    issues = spark.createDataFrame([
        (1, 1, "The load_low error in a.js", "Error at fn (src/a.js:3:1) via res://src/b.js\nNEED: src/c.js"),
        (2, 1, "Level3 died near load_low load_low", "no file"), (3, 2, "load_low a.js", "at src/a.js"), (4, 9, "load_low", "src/a.js"),
        (5, None, "load_low", "src/a.js"), (None, 1, "a.js", "src/b.js"), (1, 1, "The load_low error in a.js", "Error at fn (src/a.js:3:1) via res://src/b.js\nNEED: src/c.js"),
    ], "query_id long, project long, issue string, logs string")
    contracts = spark.createDataFrame([
        (1, "src/a.js", "function load_low(x)", ""), (1, "src/b.js", "class Level3", "died(x)"), (1, "src/c.js", "", ""), (1, "src/c.js", "", ""),
        (1, None, "class Level3", ""), (2, "src/a.js", "function load_low(x)", ""), (None, "src/a.js", "function load_low(x)", ""), (3, "src/a.js", "", "")],
        "project long, path string, export_sig string, signal_sig string")
    edges = spark.createDataFrame([(1, "src/a.js", "src/c.js", "import"), (1, "src/a.js", "src/c.js", "requires"), (1, None, "src/a.js", "import"),
                                   (1, "src/b.js", "src/a.js", "import"), (2, "src/d.js", "src/a.js", "import"), (3, "src/a.js", "src/c.js", "import")],
                                  "project long, src string, dst string, kind string")
    return issues, contracts, edges


def test_ranking_deals_tables_by_project_and_joins_in_large_ones(spark):
    issues, contracts, edges = _ranking_tables(spark)
    files = contracts.select("project", "path")
    rows = lambda frame: sorted(map(repr, map(tuple, frame.collect())))
    side = ranking.rank(issues, files, contracts, edges)
    want = rows(side)
    assert rows(ranking.rank(issues, files, contracts, edges, dealt=0)) == want == rows(ranking.rank(issues, files, contracts, edges, dealt=40))
    found = {(r.query_id, r.file): (r.score, r.line, r.reason) for r in side.filter("query_id IN (1, 3)").collect()}
    assert found[1, "src/a.js"] == (100, 3, 'Error origin at line 3; Filename matches "a.js"; Exports "load_low", named in your description; '
                                     "Direct dependency of src/b.js; Dependent of src/c.js — it may need updating too")
    assert found[3, "src/d.js"] == (70, None, "Dependent of src/a.js — it may need updating too") and (4, "src/a.js") not in found
    # rows stay where the project was dealt: nothing is dealt again by query and file
    assert "hashpartitioning(query_id" not in _plan(side)


def test_sections_carry_lengths_where_no_text_is_asked_for(spark):
    issues, contracts, edges = _ranking_tables(spark)
    files = contracts.select("project", "path", F.lit("export const a = 1;\n").alias("content")).filter("path IS NOT NULL").distinct()
    sections = context.compile_sections(issues, files, contracts, edges, budget=30)
    # only the requested files meet the targets by query and path; sections are packed where their query is
    plan = _plan(sections.select("query_id", "part", "path", "chars", "dropped"))
    assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+L, path#", plan)) == 2
    got = {(r.query_id, r.part, r.path): (r.chars, r.requested, r.dropped, len(r.text)) for r in sections.collect()}
    assert got[1, "requested", "src/c.js"] == (20, True, True, 20) and got[1, "target", "src/a.js"][1:3] == (False, False)


def test_shape_rules_read_the_fields_of_an_object_in_one_pass(spark):
    docs = ['{"version":1,"name":"L","engine":"three","seed":1,"instances":[7,{"id":"a","prefab":"p","transform":[1]}],"lights":null,"camera":{}}',
            '{"version":"1","instances":{},"camera":5,"typo":{}}', "{bad"]
    found = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, doc string").select("k", documents.shape_problems(F.col("doc")).alias("p"))
    assert _plan(found).count("variant_get(") < 100
    rows = {r.k: None if r.p is None else [p.path for p in r.p] for r in found.collect()}
    assert rows[0] == ["lights", "instances[0].id", "instances[0].prefab", "instances[0].transform", "instances[1].transform",
                       "camera.kind", "camera.position", "camera.rotation"]
    assert rows[1] == ["version", "name", "engine", "seed", "instances", "(root)", "camera"]
    assert rows[2] is None
