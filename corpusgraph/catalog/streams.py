"""Streaming queries over the event, order and part tables, run to the end of their input."""

from pyspark.sql import functions as F

from corpusgraph.catalog.fixtures import FIXTURES, query
from corpusgraph.catalog.scenes import _WITH
from corpusgraph.functions import code
from corpusgraph.streaming import feeds, incremental, stateful


def _stream(t, table, fixture=None, per_trigger=None):
    """A table as a stream; with a fixture, that fixture's text over the stream."""
    schema = t.table(table).schema
    stream = feeds.change_feed(t.spark, t.folder, schema, f"{table}.parquet", per_trigger)
    if fixture is None:
        return stream
    stream.createOrReplaceTempView(f"stream_{table}")
    return t.spark.sql(FIXTURES[fixture].replace(f"${table}", f"stream_{table}"))


@query("t1_change_feed", "SELECT event_id, project, path, after AS content FROM $F_log WHERE before IS DISTINCT FROM after")
def _(t):
    changed = _stream(t, "events", "F_log").filter(~F.col("before").eqNullSafe(F.col("after")))
    return feeds.run_to_table(changed.select("event_id", "project", "path", F.col("after").alias("content")), "feed")


@query("t2_debounce", """
    WITH m AS (SELECT key, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM $F_stream),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS session FROM m)
    SELECT key, arg_max(event_id, ts) AS event_id, count(*) AS n FROM s GROUP BY key, session
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM $F_stream)""")
def _(t):
    # A stream fires once the watermark has passed the quiet period.
    return feeds.run_to_table(stateful.debounce(_stream(t, "events", "F_stream"), "6 hours"), "debounce")


@query("t2_debounce_batch", """
    WITH m AS (SELECT key, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM $F_stream),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS session FROM m)
    SELECT key, arg_max(event_id, ts) AS event_id, count(*) AS n FROM s GROUP BY key, session""")
def _(t):
    return stateful.debounce(t("F_stream"), "6 hours")


@query("t3_echo_suppression", """
    WITH s AS (SELECT *, event_id % 3 = 0 AS own FROM $F_stream),
    w AS (SELECT *, sum(CASE WHEN own THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS block FROM s),
    h AS (SELECT *, max(CASE WHEN own THEN content_hash END) OVER (PARTITION BY key, block) AS written FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, block, own, content_hash ORDER BY ts, event_id) AS rn FROM h)
    SELECT key, event_id FROM r WHERE NOT own AND NOT (content_hash = coalesce(written, '') AND rn = 1)""")
def _(t):
    rows = _stream(t, "events", "F_stream").withColumn("own", F.col("event_id") % 3 == 0)
    return feeds.run_to_table(stateful.suppress_echoes(rows.select("key", "event_id", "ts", "own", "content_hash")), "echo")


@query("t4_bounded_tail", """
    SELECT key, event_id, CAST(rn AS INT) AS age FROM (SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM $F_stream) r
    WHERE rn <= 40""")
def _(t):
    tails = stateful.bounded_tail(_stream(t, "events", "F_stream").select("key", "event_id", "ts"), 40)
    return stateful.latest_tail(feeds.run_to_table(tails, "tail")).select("key", "event_id", "age")


@query("t5_undo_redo_stream", """WITH RECURSIVE a AS (SELECT project, event_id, action, row_number() OVER (PARTITION BY project ORDER BY ts, event_id) AS n FROM $F_actions),
    s(project, n, event_id, ok, u, r) AS (SELECT DISTINCT project, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, 0, 0 FROM a
      UNION ALL SELECT s.project, a.n, a.event_id, CASE a.action WHEN 'record' THEN true WHEN 'undo' THEN u > 0 ELSE r > 0 END,
        CASE a.action WHEN 'record' THEN least(u + 1, 20) WHEN 'undo' THEN greatest(u - 1, 0) ELSE CASE WHEN r > 0 THEN u + 1 ELSE u END END,
        CASE a.action WHEN 'record' THEN 0 WHEN 'undo' THEN CASE WHEN u > 0 THEN r + 1 ELSE r END ELSE greatest(r - 1, 0) END
      FROM s JOIN a ON a.project = s.project AND a.n = s.n + 1)
    SELECT project, event_id, ok, u AS undo_count, r AS redo_count FROM s WHERE n > 0""")
def _(t):
    return feeds.run_to_table(stateful.undo_redo(_stream(t, "events", "F_actions"), 20), "undo")


@query("t6_incremental_validation", _WITH + " SELECT scene, path, message FROM shape UNION ALL SELECT scene, path, message FROM relation")
def _(t):
    # an earlier version of every document comes along, whose text is the greater one
    docs = _stream(t, "orders", "F_scene").select("scene", F.inline(F.array(
        F.struct(F.lit(1).alias("version"), F.concat(F.lit("~"), "doc").alias("doc")), F.struct(F.lit(2).alias("version"), F.col("doc").alias("doc")))))
    return incremental.revalidate(docs, "version")


@query("t7_graph_refresh", """
    SELECT path AS src, CASE WHEN path IN (SELECT 'src/p' || CAST(p_partkey AS STRING) || '.js' FROM $part WHERE p_size > 25) THEN './q.js'
      ELSE regexp_extract(content, '(?m)^import \\{ \\w+ \\} from "([^"]+)"', 1) END AS dst FROM $F_code""")
def _(t):
    def extract(files):
        return files.select(F.col("path").alias("src"), F.explode(code.imports(F.col("content"))).alias("i")).select("src", F.col("i.specifier").alias("dst"))

    changed = _stream(t, "part", "F_code").filter(F.regexp_extract("content", r"let shared = (\d+)", 1).cast("int") > 25)
    linked = lambda to: F.regexp_replace("content", r"\./p\d+\.js", to)
    new = changed.select("path", F.inline(F.array(  # the later version is the lesser text
        F.struct(F.lit(1).alias("version"), linked("./z.js").alias("content")), F.struct(F.lit(2).alias("version"), linked("./q.js").alias("content")))))
    return incremental.refresh_edges(extract(t("F_code")), new, extract, "version")


@query("t8_repeated_content", """
    SELECT key, event_id FROM (SELECT *, lag(content_hash) OVER (PARTITION BY key ORDER BY ts, event_id) AS prev FROM $F_stream) s
    WHERE prev IS DISTINCT FROM content_hash""")
def _(t):
    return feeds.run_to_table(stateful.drop_repeats(_stream(t, "events", "F_stream").select("key", "event_id", "ts", "content_hash")), "repeats")


@query("t8_repeated_content_batch", """
    SELECT key, event_id FROM (SELECT *, lag(content_hash) OVER (PARTITION BY key ORDER BY ts, event_id) AS prev FROM $F_stream) s
    WHERE prev IS DISTINCT FROM content_hash""")
def _(t):
    return stateful.drop_repeats_batch(t("F_stream")).select("key", "event_id")
