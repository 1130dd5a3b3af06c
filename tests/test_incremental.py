"""The append-only edge log: versions, deletions, restarts and compaction."""

from pyspark.sql import functions as F

from corpusgraph.streaming import feeds, incremental

SCHEMA = "path string, content string, version int"


def extract(files):
    return files.select(F.col("path").alias("src"), F.explode(F.split("content", " ")).alias("dst"))


def edges_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_edge_log_goes_on_where_it_ended(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "log")
    base = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "src string, dst string")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: incremental.refresh_edges(base, feeds.change_feed(spark, source, spark.createDataFrame([], SCHEMA).schema), extract, "version", place)
    put([("a", "z", 1), ("a", "p q", 3), ("a", "zz", 2)])
    assert edges_of(run()) == [("a", "p"), ("a", "q"), ("b", "x"), ("c", "y")]
    assert edges_of(run()) == [("a", "p"), ("a", "q"), ("b", "x"), ("c", "y")]  # nothing new
    put([("b", None, 2), ("b", "w", 1), ("d", "x", 1)])
    want = [("a", "p"), ("a", "q"), ("c", "y"), ("d", "x")]
    assert edges_of(run()) == want
    # a batch that runs again replaces its own rows
    spark.createDataFrame([("d", "x")], "src string, dst string").write.mode("overwrite").parquet(f"{place}/edges/batch=1")
    assert edges_of(incremental.current_edges(spark, place, base.schema)) == want
    assert spark.read.parquet(f"{place}/edges/batch=1").count() == 1  # only what changed is written
    incremental.compact_edges(spark, place, base.schema, str(tmp_path / "next"))
    assert edges_of(incremental.current_edges(spark, str(tmp_path / "next"), base.schema)) == want
    assert spark.read.parquet(str(tmp_path / "next/edges")).count() == len(want)
