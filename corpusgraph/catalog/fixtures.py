"""Input tables of the named queries, derived from the test tables.

Every text below is valid in Spark SQL and in DuckDB. ``$name`` stands for a test
table or another fixture. No fixture samples its source: each one reads whole
tables, so the work of every query grows with them. Conditions that remain say
what a row means (only assistants reply, only some assets exist).
"""

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIXTURES = {
    # corpus of text files
    "F_files": """
        SELECT source AS project, source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path,
               n_chars AS size, text AS content
        FROM $documents""",
    # awkward raw paths
    "F_paths": """
        SELECT doc_id, source AS project,
               CASE doc_id % 8 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/../' WHEN 2 THEN './src//'
                 WHEN 3 THEN '/abs/' WHEN 4 THEN 'res://scenes/' WHEN 5 THEN 'prefabs/'
                 WHEN 6 THEN 'src' || chr(92) || 'win' || chr(92) ELSE 'vendor/lib/' END
               || lang || CAST(doc_id AS STRING)
               || CASE doc_id % 7 WHEN 0 THEN '.js' WHEN 1 THEN '.min.js' WHEN 2 THEN '.TS' WHEN 3 THEN '.gd'
                 WHEN 4 THEN '.png' WHEN 5 THEN '.scene.json' ELSE '' END AS raw_path
        FROM $documents""",
    # one source file per order; a project is a customer, and file names repeat from project to project
    "F_sources": """
        SELECT project, file_no, order_no, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority, area,
               'src/' || area || '/' || CAST(file_no AS STRING) || '.js' AS path
        FROM (SELECT o_custkey AS project, o_orderkey AS order_no, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority,
                CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS file_no,
                lower(replace(substr(o_orderpriority, 3), ' ', '_')) AS area
              FROM $orders) o""",
    # graph nodes of each project: every source file, the assets that it needs and that exist, and assets that nothing needs
    "F_nodes": """
        SELECT project, path AS id,
               CASE o_orderstatus WHEN 'F' THEN 'module' WHEN 'O' THEN 'scene' ELSE 'script' END AS type,
               CASE o_orderstatus WHEN 'P' THEN 'godot' ELSE 'js' END AS engine, area AS label
        FROM $F_sources
        UNION ALL
        SELECT a.project, 'models/' || CAST(p.p_partkey AS STRING) || '.glb', 'asset', 'js', p.p_brand || '/' || p.p_name
        FROM $part p JOIN (
          SELECT s.project, l.l_partkey AS part FROM $lineitem l JOIN $F_sources s ON l.l_orderkey = s.order_no
          UNION SELECT p_partkey, p_partkey FROM $part) a ON a.part = p.p_partkey
        WHERE p.p_size <= 15""",
    # typed edges: earlier file of the area, next cheaper file, itself, a lost file, assets
    "F_deps": """
        SELECT project, src, dst, kind FROM (
          SELECT project, path AS src,
                 lag(path) OVER (PARTITION BY project, area ORDER BY o_orderdate, file_no) AS dst, 'import' AS kind
          FROM $F_sources
          UNION ALL
          SELECT project, src, dst, 'requires' FROM (
            SELECT project, path AS src, o_orderstatus,
                   lag(path) OVER (PARTITION BY project ORDER BY o_totalprice, file_no) AS dst
            FROM $F_sources) cheaper
          WHERE o_orderstatus = 'F'
          UNION ALL
          SELECT project, path, path, 'signal_connection' FROM $F_sources
          WHERE o_orderstatus = 'P' AND area = 'urgent' AND o_totalprice > 400000
          UNION ALL
          SELECT project, path, 'lost/' || CAST(file_no AS STRING) || '.tscn', 'ext_resource' FROM $F_sources
          WHERE o_orderstatus = 'O' AND area = 'low'
          UNION ALL
          SELECT DISTINCT s.project, s.path, 'models/' || CAST(l.l_partkey AS STRING) || '.glb', 'asset_ref'
          FROM $lineitem l JOIN $F_sources s ON l.l_orderkey = s.order_no
        ) e WHERE dst IS NOT NULL""",
    # the same with ids that name their project
    "F_knodes": "SELECT CAST(project AS STRING) || '|' || id AS id, project, type, engine FROM $F_nodes",
    "F_kdeps": """
        SELECT CAST(project AS STRING) || '|' || src AS src, CAST(project AS STRING) || '|' || dst AS dst, kind, project FROM $F_deps""",
    # hierarchy with self-parents, missing parents and cycles
    "F_tree": """
        SELECT c_custkey AS id, c_mktsegment AS prefab, c_name AS name,
               CASE WHEN c_custkey % 50 = 7 THEN c_custkey + 10000000 WHEN c_custkey % 97 = 5 THEN c_custkey
                 WHEN c_custkey % 101 = 3 THEN c_custkey * 3 + 1 WHEN c_custkey = 0 THEN NULL
                 ELSE CAST(floor(c_custkey / 3) AS BIGINT) END AS parent,
               c_custkey % 11 = 0 AS locked
        FROM $customer""",
    # JSON parameters per instance
    "F_params": """
        SELECT event_id, event_type AS prefab, user_id AS instance_id, props AS params, value FROM $events""",
    # file changes in time order
    "F_log": """
        SELECT event_id, user_id AS project, ts, event_type, 'src/' || CAST(event_id % 9 AS STRING) || '.js' AS path,
               CASE WHEN value < 2 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS before,
               CASE WHEN event_id % 17 = 0 THEN NULL
                 ELSE CAST(CAST(floor(value / (1 + event_id % 4)) AS BIGINT) AS STRING) END AS after
        FROM $events""",
    # record / undo / redo per project
    "F_actions": """
        SELECT user_id AS project, event_id, ts,
               CASE event_type WHEN 'click' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'record' END AS action
        FROM $events""",
    # exported signatures per file
    "F_contracts": """
        SELECT project, path, file_no,
               CASE o_orderstatus WHEN 'F' THEN 'function load_' || area || '(x,  y)'
                 WHEN 'O' THEN 'class Level' || CAST(order_no % 10 AS STRING)
                 ELSE CASE area WHEN 'low' THEN '' ELSE 'const speed_' || area END END AS export_sig,
               CASE area WHEN 'urgent' THEN 'died_' || lower(o_orderstatus) || '()' ELSE '' END AS signal_sig
        FROM $F_sources""",
    # text of every source file; lengths differ
    "F_bodies": """
        SELECT project, path, file_no, 'import { start } from "./boot.js";' || chr(10)
               || 'export function load_' || area || '(x, y) {' || chr(10) || '  return x + ' || CAST(order_no AS STRING) || ';' || chr(10)
               || '}' || chr(10) || repeat('// note' || chr(10), CAST(order_no % 90 AS INT)) || 'export const speed = '
               || CAST(project AS STRING) || ';' || repeat(chr(10) || '//', CAST(CASE WHEN order_no % 50 = 0 THEN 210 ELSE 0 END AS INT)) AS content
        FROM $F_sources""",
    # one query per event: description and log
    "F_issues": """
        SELECT e.event_id AS query_id, e.user_id AS project,
               'The ' || CASE e.event_id % 3 WHEN 0 THEN 'load_' || coalesce(p.area, 'none') WHEN 1 THEN 'died_f'
                 ELSE 'speed_high' END || ' error when calling Level' || CAST(e.event_id % 10 AS STRING)
                 || '() in file ' || CAST(coalesce(p.last_no, 0) AS STRING) || '.js' AS issue,
               'Error at fn (' || coalesce(p.first_path, 'src/gone.js') || ':' || CAST(e.user_id % 40 + 1 AS STRING)
                 || ':1) via res://' || coalesce(p.last_path, 'src/lost.js')
                 || CASE WHEN e.event_id % 5 = 0 THEN chr(10) || 'NEED: src/high/'
                   || CAST(coalesce(p.last_no, 0) AS STRING) || '.js' ELSE '' END AS logs
        FROM $events e LEFT JOIN (
          SELECT project, min(path) AS first_path, max(path) AS last_path, max(file_no) AS last_no, min(area) AS area
          FROM $F_sources GROUP BY project) p ON p.project = e.user_id""",
    # before / after text
    "F_versions": """
        SELECT doc_id, text AS before,
               replace(replace(text, ' the ', ' THE '), chr(10) || 'The', chr(10) || chr(10) || 'The') AS after
        FROM $documents""",
    # replies with FILE blocks, bad paths, bad JSON and request lines
    "F_replies": """
        SELECT conv_id * 100 + turn AS reply_id,
               '### FILE: src/' || CAST(conv_id % 40 AS STRING)
                 || CASE turn % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.js' ELSE '/../x.js' END || chr(10) || '```' || chr(10)
                 || CASE WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN '{"a": 1}' ELSE text END || chr(10) || '```' || chr(10)
                 || CASE WHEN turn % 4 = 1
                   THEN 'NEED: src/' || CAST(conv_id % 90 AS STRING) || '.js, track.gd' || chr(10) ELSE '' END AS reply
        FROM $conversations WHERE role = 'assistant'""",
    # file, snippet to find, replacement
    "F_edits": """
        SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, text AS content,
               split_part(text, chr(10), 2) AS find, 'X: ' || split_part(text, chr(10), 2) || '!' AS replace
        FROM $documents""",
    # replies with one EDIT block per document
    "F_edit_replies": """
        SELECT doc_id AS reply_id, '### EDIT: ' || path || chr(10) || '<<<<<<< FIND' || chr(10) || find || chr(10)
               || '=======' || chr(10) || replace || chr(10) || '>>>>>>> REPLACE' || chr(10) AS reply
        FROM $F_edits""",
    # log lines with file references
    "F_logs": """
        SELECT event_id AS query_id,
               'Error at fn (src/' || CAST(event_id % 2500 AS STRING) || '.js:' || CAST(user_id AS STRING)
                 || ':1) via res://scripts/' || CAST(user_id % 20 AS STRING) || '.gd and lib'
                 || CAST(event_id % 5 AS STRING) || '.md' AS logs
        FROM $events""",
    # import specifiers per file
    "F_imports": """
        SELECT l_suppkey AS project, l_orderkey, l_linenumber,
               'src/m' || CAST(l_partkey % 50 AS STRING) || '/f' || CAST(l_orderkey % 10 AS STRING) || '.ts' AS path,
               CASE l_linenumber % 4 WHEN 0 THEN './f' WHEN 1 THEN '../m' || CAST(l_partkey % 7 AS STRING) || '/f'
                 WHEN 2 THEN '/src/m1/f' ELSE 'three/f' END || CAST(l_orderkey % 12 AS STRING)
                 || CASE l_linenumber % 2 WHEN 0 THEN '.js' ELSE '' END AS specifier
        FROM $lineitem""",
    # generated source text
    "F_code": """
        SELECT p_partkey AS file_id, 'src/p' || CAST(p_partkey AS STRING) || '.js' AS path,
               '// import { no } from "./comment.js"' || chr(10)
               || 'import { a' || CAST(p_size AS STRING) || ' } from "./p' || CAST(p_partkey % 97 AS STRING) || '.js";' || chr(10)
               || 'export function f' || CAST(p_size AS STRING) || '(x, y) {' || chr(10)
               || '  return Math.random() + "models/' || p_name || '.glb".length;' || chr(10) || '}' || chr(10)
               || 'let shared = ' || CAST(p_size AS STRING) || ';' || chr(10)
               || 'export const K' || CAST(p_partkey AS STRING) || ' = window.x;' || chr(10) AS content
        FROM $part""",
    # script text of the other engine
    "F_scripts": """
        SELECT s_suppkey AS file_id, 'scripts/s' || CAST(s_suppkey AS STRING) || '.gd' AS path,
               'extends Node' || chr(10) || 'signal died(reason,  by)' || chr(10)
               || 'signal woke' || chr(10)
               || '@export var speed: float = ' || CAST(s_nationkey AS STRING) || '.0' || chr(10)
               || 'const MAX_' || CAST(s_nationkey AS STRING) || ' := 3' || chr(10)
               || 'const _HIDDEN = 1' || chr(10) || 'enum Mode { A, B }' || chr(10)
               || 'func run(delta: float) -> void:' || chr(10) || '    Game.tick(' || CAST(s_suppkey AS STRING) || ')' || chr(10)
               || 'func _ready():' || chr(10) || '    pass' || chr(10)
               || CASE WHEN s_suppkey % 4 = 0 THEN 'func broken()' || chr(10) ELSE '' END
               || 'func stop():' || chr(10) || '    var inner = 1' || chr(10) AS content
        FROM $supplier""",
    # section text with quoting traps; a scene instances itself or one of another project
    "F_ini": """
        SELECT s_suppkey AS file_id, 'scenes/S' || CAST(s_suppkey AS STRING) || '.tscn' AS path,
               CASE WHEN s_suppkey % 10 = 3 THEN '' ELSE '[gd_scene load_steps=3 format=3]' || chr(10) END
               || '[ext_resource type="PackedScene" path="res://scenes/S' || n || '.tscn" id="1_p"]' || chr(10)
               || '[ext_resource type="Script" path="res://scripts/' || CASE WHEN s_suppkey % 3 = 0 THEN 'a]b'
                 ELSE 's' || CAST(s_suppkey AS STRING) END || '.gd" id="2_s"]' || chr(10)
               || '[ext_resource type="Texture" path="res://art/' || n || '.png" id="3_t"]' || chr(10)
               || '; comment' || chr(10) || '[node name="Root" type="Node2D"]' || chr(10)
               || 'script = ExtResource("2_s")' || chr(10)
               || '[node name="S' || n || '" parent="." instance=ExtResource("1_p")]' || chr(10)
               || CASE WHEN s_suppkey % 9 = 0 THEN '[connection signal="died" from="S1"]'
                 ELSE '[connection signal="died" from="s' || n || '" to="." method="_on"]' END || chr(10)
               AS content
        FROM (SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey ELSE s_nationkey END AS STRING) AS n
              FROM $supplier) s""",
    # engine settings with an autoload section
    "F_settings": """
        SELECT s_suppkey AS file_id,
               '[application]' || chr(10) || 'config/name="g"' || chr(10) || 'Fake="*res://no.gd"' || chr(10)
               || '[autoload]' || chr(10) || chr(10) || 'Game="*res://core/game' || CAST(s_nationkey AS STRING) || '.gd"' || chr(10)
               || 'bad line' || chr(10) || 'Bus = "res://core/bus.gd"' || chr(10)
               || '[input]' || chr(10) || 'Other="*res://other.gd"' || chr(10) AS content
        FROM $supplier""",
    # assets with companion slot, registry entry and hint
    "F_assets": """
        SELECT p_partkey AS asset_id, 'models/' || p_name || CAST(p_partkey AS STRING)
                 || CASE p_size % 3 WHEN 0 THEN '.glb' WHEN 1 THEN '.PNG' ELSE '.ogg' END AS path,
               p_size * 100 AS size_kb,
               CASE WHEN p_size % 4 = 0 THEN '{"slot":"' || p_type || '","rigged":'
                 || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END
                 || ',"animations":"idle, run","max_size_kb":2500}' ELSE NULL END AS companion_json,
               CASE WHEN p_size % 5 = 0 THEN '{"name":"reg","format":"GLB","expected_animations":["walk","idle"]}'
                 ELSE NULL END AS registry_json,
               '// @slot models/' || p_name || CAST(p_partkey AS STRING) || '.ogg: format=glb animations=[walk, idle]' AS hint
        FROM $part""",
    # package manifests, some malformed
    "F_pkg": """
        SELECT c_custkey AS project,
               CASE WHEN c_custkey % 13 = 0 THEN '{bad' ELSE '{"dependencies":{"three":"'
                 || CASE c_custkey % 3 WHEN 0 THEN '0.180.0' WHEN 1 THEN '^0.180.0' ELSE '0.179.1' END
                 || '","zod":"3.23.8"},"devDependencies":{"vitest":"2.1.0"}}' END AS package_json
        FROM $customer""",
    # keyed events with content hash
    "F_stream": """
        SELECT event_id, user_id AS key, ts, value, md5(CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS content_hash
        FROM $events""",
    # rendered counts, some incomplete
    "F_brief": """
        SELECT o_orderkey AS brief_id,
               '<!-- brief mode=' || CASE o_orderkey % 2 WHEN 0 THEN 'oneShot' ELSE 'interactive' END || ' -->' || chr(10)
               || '- Graph: ' || CAST(o_orderkey * 3 AS STRING) || ' node(s), ' || CAST(o_custkey * 5 AS STRING) || ' edge(s)' || chr(10)
               || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '- Prefab modules: 4' END || chr(10)
               || '- Scene instances: 12' || chr(10) AS markdown
        FROM $orders""",
    # scene documents, some with one or more defects
    "F_scene": """
        SELECT o_orderkey AS scene,
               CASE WHEN o_orderkey % 23 = 0 THEN '{"version":' ELSE
               '{"version":' || CASE WHEN o_orderkey % 10 = 0 THEN '2' ELSE '1' END || ',"name":"L' || CAST(o_orderkey AS STRING)
               || '","engine":"three","seed":' || CAST(o_custkey AS STRING) || ',"instances":[{"id":"a","prefab":"' || o_orderpriority
               || '","transform":{"position":[1,2' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',3' END
               || '],"rotation":[0,0,0],"scale":[1,1,1]},"params":{"size":2}},{"id":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'a' ELSE 'b' END
               || '","prefab":"cube","parent":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'zz' ELSE 'a' END
               || '","transform":{"position":[0,0,0],"rotation":[0,0,0],"scale":[1,1,1]},"params":{}}],"lights":[{"id":"sun","kind":"ambient","color":"'
               || CASE WHEN o_orderkey % 13 = 0 THEN 'white' ELSE '#ffffff' END || '","intensity":' || CAST(o_orderkey % 19 - 1 AS STRING)
               || '}],"camera":{"kind":"perspective","position":[0,5,10],"rotation":[0,0,0],"fov":' || CAST(o_orderkey % 190 AS STRING) || '}'
               || CASE WHEN o_orderkey % 11 = 0 THEN ',"typo":1' ELSE '' END || '}' END AS doc
        FROM $orders""",
}

#: The same rows for Spark where it plans another text better.
FOR_SPARK = {
    # the window goes by the renamed column, so that Spark knows the rows to be dealt by project
    "F_sources": """
        SELECT project, file_no, order_no, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority, area,
               'src/' || area || '/' || CAST(file_no AS STRING) || '.js' AS path
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY order_no) AS BIGINT) AS file_no
              FROM (SELECT o_custkey AS project, o_orderkey AS order_no, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority,
                      lower(replace(substr(o_orderpriority, 3), ' ', '_')) AS area
                    FROM $orders) r) o""",
}

# a path is its area and its number, so assets are told apart before texts are made of them
FOR_SPARK["F_deps"] = FIXTURES["F_deps"].replace("""
          SELECT DISTINCT s.project, s.path, 'models/' || CAST(l.l_partkey AS STRING) || '.glb', 'asset_ref'
          FROM $lineitem l JOIN $F_sources s ON l.l_orderkey = s.order_no""", """
          SELECT project, 'src/' || area || '/' || CAST(file_no AS STRING) || '.js', 'models/' || CAST(part AS STRING) || '.glb', 'asset_ref'
          FROM (SELECT DISTINCT s.project, s.area, CASE WHEN s.area IS NOT NULL THEN s.file_no END AS file_no, l.l_partkey AS part
                FROM $lineitem l JOIN $F_sources s ON l.l_orderkey = s.order_no WHERE l.l_partkey IS NOT NULL) a""")

_NAME = re.compile(r"\$(\w+)")


def spark_text(sql: str, folder: str) -> str:
    """Replace every ``$name`` for Spark: fixtures inline, tables by file."""
    def one(match: re.Match) -> str:
        name = match.group(1)
        if name in FIXTURES:
            return f"({spark_text(FOR_SPARK.get(name, FIXTURES[name]), folder)})"
        return f"parquet.`{folder}/{name}.parquet`"

    return _NAME.sub(one, sql)


def duck_text(sql: str) -> str:
    """One statement for DuckDB with the used fixtures as common table expressions."""
    used: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in FIXTURES and name not in used:
                visit(FIXTURES[name])
                used[name] = FIXTURES[name]

    visit(sql)
    body = _NAME.sub(lambda m: m.group(1), sql.strip())
    defs = [f"{n} AS ({_NAME.sub(lambda m: m.group(1), t).strip()})" for n, t in used.items()]
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        body = body[head.end():]
        return "WITH RECURSIVE " + ", ".join(defs + [body]) if defs else "WITH RECURSIVE " + body
    return ("WITH " + ", ".join(defs) + " " if defs else "") + body


# Fixtures whose rows are costly to process.
COSTLY = {
    "F_files", "F_code", "F_scene", "F_edits", "F_edit_replies", "F_versions", "F_ini", "F_assets",
    "F_brief", "F_logs",
}


class Inputs:
    """Fixture and table access for one session and one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(spark_text(text, self.folder))

    def __call__(self, fixture: str) -> DataFrame:
        """A fixture; costly rows of a one-file test table are spread over the cores.

        Such a file has one row group and so feeds one task. Tables on a cluster are
        folders of many files: their scans are wide and are left alone.
        """
        frame = self.sql(FOR_SPARK.get(fixture, FIXTURES[fixture]))
        tables = [n for n in _NAME.findall(FIXTURES[fixture]) if n in TABLES] or ["orders"]
        if fixture in COSTLY and all(Path(f"{self.folder}/{n}.parquet").is_file() for n in tables):
            return frame.repartition(self.spark.sparkContext.defaultParallelism)
        return frame


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a named query and, where SQL can say it, its SQL twin."""
    def keep(function: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = duck_text(oracle)
        return function

    return keep
