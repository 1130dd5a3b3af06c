"""Sizes, nulls and versions beyond the usual: nothing is cut, dropped or left to chance."""

from pyspark.sql import functions as F

from corpusgraph.functions import slots, text
from corpusgraph.functions.markup import tag_attribute
from corpusgraph.operators import diffs, hierarchy, history, patches, search
from corpusgraph.streaming.incremental import last_version


def test_long_files_have_an_exact_diff(spark):
    before = [f"line {i % 700}" for i in range(10_000)]
    after = before[:2000] + ["new"] + before[2000:7000] + before[7100:] + ["end"]
    frame = spark.createDataFrame([(1, "\n".join(before), "\n".join(after))], "k int, before string, after string")
    diffed = diffs.line_diff(frame)
    rows = diffs.operation_rows(diffed, "k").collect()
    assert [r.line for r in rows if r.type != "add"] == before and [r.line for r in rows if r.type != "delete"] == after
    assert sum(r.type != "context" for r in rows) == 102
    assert diffs.hunk_rows(diffed, "k").count() >= 3


def test_wide_positions_keep_their_order(spark):
    ids = [1_000_000_000_001, 999_999_999_999, 1_000_000_000_009, 7]
    tree = spark.createDataFrame([(i, None, i, 0) for i in ids], "id long, parent long, ord long, depth int")
    keys = {r.id: r.order_key for r in hierarchy.flatten(tree).collect()}
    assert sorted(ids) == sorted(ids, key=keys.get) and len(set(keys.values())) == 4


def test_null_projects_and_times_are_numbered(spark):
    log = spark.createDataFrame([("p", 1, "2024-01-01"), (None, 2, "2024-01-01"), (None, 3, None), ("p", 4, None)],
                                "project string, event_id long, day string").select(
        "project", "event_id", F.to_timestamp("day").alias("ts"), F.lit("f").alias("path"), F.lit("a").alias("before"), F.lit("b").alias("after"))
    got = {r.event_id: r.step for r in history.record_steps(log).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1}


def test_last_version_of_a_batch(spark):
    batch = spark.createDataFrame([("a", "old", 1), ("a", "new", 3), ("a", "mid", 2), ("b", "x", 1)], "path string, content string, v int")
    assert {tuple(r) for r in last_version(batch, "path", "content", "v").collect()} == {("a", "new"), ("b", "x")}
    assert {tuple(r) for r in last_version(batch, "path", "content", None).collect()} == {("a", "old"), ("b", "x")}


def test_long_links_formats_and_uncapped_search(spark):
    link = "x" * 2000 + ".js"
    frame = spark.createDataFrame([(f"<script src={link}></script>",)], "html string")
    assert frame.select(tag_attribute(F.col("html"), "script", "src")).first()[0] == [link]
    files = spark.createDataFrame([("a.txt", "\n".join(["hit"] * 600), 600), ("b.txt", "hit " * 800_000, 3_200_000)],
                                  "path string, content string, size long")
    assert search.search(files, "hit", "contents").count() == 601
    page = search.summary(files, "hit", 50, 500, 200).first()
    assert page.line_hits == 51 and page.skipped == 0 and page.files_cut == 1


def test_names_by_words_and_slots_by_pairs(spark):
    signatures = {"async function load(a)": "load", "function* gen()": "gen", "class Foo extends Bar": "Foo", "const x = 1": "x",
                  "async (x)": "async", "plain(a)": "plain", "(a) => b": None, "": None}
    frame = spark.createDataFrame([(k,) for k in signatures], "s string")
    assert {r.s: r.n for r in frame.select("s", text.binding_name(F.col("s")).alias("n")).collect()} == signatures
    calls = {"call foo.bar (1) and baz(2)": "bar", "the method  apply fails": "apply", "nothing here": None}
    frame = spark.createDataFrame([(k,) for k in calls], "s string")
    assert {r.s: r.n for r in frame.select("s", text.called_symbol(F.col("s")).alias("n")).collect()} == calls
    code = "// @slot models/a.glb: animations = [run, walk], format=glb dimensions = 10x20, rigged=true\n"
    hint = spark.createDataFrame([(code,)], "c string").select(slots.hints(F.col("c")).alias("h")).first().h[0].slot
    assert (hint.animations, hint.format, hint.dimensions, hint.rigged) == (["run", "walk"], "glb", "10x20", True)


def test_one_path_in_two_projects(spark):
    files = spark.createDataFrame([("p1", "src/a.js", "let a = 1;\n"), ("p2", "src/a.js", "let other = 5;\n")], "project string, path string, content string")
    reply = "EDIT: src/a.js\n<<<<<<< FIND\nlet a = 1;\n=======\nlet a = 2;\n>>>>>>> REPLACE\n"
    replies = spark.createDataFrame([("p1", 1, reply)], "project string, reply_id int, reply string")
    rows = patches.staged(replies, files).collect()
    assert [(r.project, r.reply_id, r.before) for r in rows] == [("p1", 1, "let a = 1;\n")]
    changes = spark.createDataFrame([("p1", "src/a.js", "let a = 2;\n")], "project string, path string, after string")
    after = {(r.project, r.content) for r in patches.next_version(files, changes).collect()}
    assert after == {("p1", "let a = 2;\n"), ("p2", "let other = 5;\n")}
