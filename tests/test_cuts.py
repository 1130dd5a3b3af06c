"""Nothing is cut unless a caller asks: one case beyond each size that used to be a limit."""

from pyspark.sql import functions as F

from corpusgraph.functions import code
from corpusgraph.operators import context, graph, search
from corpusgraph.sources import files


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_hits_far_into_a_line(spark):
    line = "  " + "x" * 400 + " needle " + "y" * 400
    table = spark.createDataFrame([("p", 1, line)], "path string, size long, content string")
    hit = search.line_hits(table, "needle").first()
    assert (hit.column, hit.text) == (402, line.strip())
    assert search.line_hits(table, "needle", chars=300).first().text == "x" * 300 + "…"


def test_sizes_of_files(spark):
    big = "a\n" * 300_000
    table = spark.createDataFrame([("p", "f.txt", len(big), big)], "project string, path string, size long, content string")
    assert context.size_gate(table).first().verdict == "attach" and context.size_gate(table, 10).first().content is None
    targets = spark.createDataFrame([(1, "p", "f.txt", None, None, False)],
                                    "query_id long, project string, target string, line long, symbol string, requested boolean")
    full = context.target_sections(targets, table.select("project", "path", "content")).first()
    assert (full.kind, full.text) == ("full", big)
    assert context.target_sections(targets, table.select("project", "path", "content"), whole_lines=200).first().kind == "signatures"
    assert table.select(context.outline(F.col("path"), F.col("content")).alias("o")).first().o == big


def test_deep_scenes(spark):
    path = "scenes/" + "d/" * 9 + "a.scene.json"
    table = spark.createDataFrame([("p", path)], "project string, path string")
    assert files.discover_scenes(table).first().scene_path == path and files.discover_scenes(table, 4).count() == 0


def test_long_labels_and_lint_texts(spark):
    long = "make(" + ", ".join(f"argument{k}" for k in range(20)) + ")"
    assert one(spark, f"export default {long};", code.exports)[0]["name"] == long
    assert one(spark, "let shared = someLongInitialiser(1, 2, 3);", code.lint)[0]["text"] == "let shared = someLongInitialiser(1, 2, 3);"


def test_all_layers_are_listed(spark):
    chain = [(f"n{k:02d}", f"n{k - 1:02d}", "import") for k in range(1, 30)]
    nodes = spark.createDataFrame([(f"n{k:02d}", "module") for k in range(30)], "id string, type string")
    counts = {r.metric: r.n for r in graph.section_counts(nodes, spark.createDataFrame(chain, "src string, dst string, kind string")).collect()}
    assert counts["layers"] == 30 and all(counts[f"layer {k}"] == 1 for k in range(30))
