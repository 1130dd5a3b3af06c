"""Scene documents, edits, validation, slots, problems and seeded draws."""

import uuid

from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.catalog.extraction import SLOTS_SQL, resolved_slots
from corpusgraph.catalog.fixtures import query
from corpusgraph.functions import seeded as R
from corpusgraph.operators import scenes as N
from corpusgraph.operators import validation as V
from corpusgraph.session import checkpoint_folder
from corpusgraph.sources import scenes as S


def _place(t, name):
    return f"{checkpoint_folder(t.spark).rstrip('/')}/corpusgraph/{name}-{uuid.uuid4().hex}"


_SHAPES = """SELECT scene, 'version' AS path, 'must be exactly 1' AS message FROM s WHERE scene % 10 = 0
    UNION ALL SELECT scene, 'instances[0].transform.position', 'must have exactly 3 components (x, y, z)' FROM s WHERE scene % 7 = 0
    UNION ALL SELECT scene, 'lights[0].color', 'must be a 6-digit hex colour, e.g. "#ffffff"' FROM s WHERE scene % 13 = 0
    UNION ALL SELECT scene, 'lights[0].intensity', 'must be at least 0' FROM s WHERE scene % 19 = 0
    UNION ALL SELECT scene, 'camera.fov', 'must be between 1 and 179' FROM s WHERE scene % 190 NOT BETWEEN 1 AND 179
    UNION ALL SELECT scene, '(root)', 'Unrecognized key typo' FROM s WHERE scene % 11 = 0"""
_WITH = f"""WITH s AS (SELECT scene FROM $F_scene WHERE scene % 23 <> 0), shape AS ({_SHAPES}),
    clean AS (SELECT scene FROM s WHERE scene NOT IN (SELECT scene FROM shape)),
    relation AS (SELECT scene, 'instances[1].id' AS path, 'duplicate id "a" — first defined at instances[0]' AS message FROM clean WHERE scene % 4 = 0
      UNION ALL SELECT scene, 'instances[1].parent', 'parent "zz" does not exist — no instance has that id' FROM clean WHERE scene % 3 = 0
      UNION ALL SELECT scene, 'instances[1].parent', 'instance "a" parents itself' FROM clean WHERE scene % 4 = 0 AND scene % 3 <> 0)"""


@query("s7_document_status", _WITH + """
    SELECT f.scene, CASE WHEN f.scene % 23 = 0 THEN 'bad_json' WHEN f.scene IN (SELECT scene FROM shape) THEN 'bad_shape' ELSE 'ok' END AS status
    FROM $F_scene f""")
def _(t):
    return S.read_status(t("F_scene")).select("scene", "status")


@query("s8_document_write", _WITH + """
    SELECT scene, doc FROM $F_scene WHERE scene IN (SELECT scene FROM clean) AND scene NOT IN (SELECT scene FROM relation)""")
def _(t):
    place = _place(t, "scenes")
    S.write_documents(V.valid_documents(t("F_scene")), place)
    return t.spark.read.schema("scene bigint, doc string").parquet(place)


@query("s9_manifest_round_trip", """
    SELECT '2024-01-01T00:00:00Z' AS generated_at, 'game' AS project_root, id AS a, type AS b, engine AS c FROM $F_nodes
    UNION ALL SELECT '2024-01-01T00:00:00Z', 'game', src, dst, kind FROM $F_deps""")
def _(t):
    place = _place(t, "manifest")
    S.write_manifest(t("F_nodes"), t("F_deps"), "game", "2024-01-01T00:00:00Z", place)
    nodes, edges = S.read_manifest(t.spark, place)
    stamp = ["generated_at", "project_root"]
    return nodes.select(*stamp, F.col("id").alias("a"), F.col("type").alias("b"), F.col("engine").alias("c")).unionByName(
        edges.select(*stamp, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("c")))


@query("s10_row_validation", f"""
    WITH e AS (SELECT p_partkey AS row_no, p_size, p_type FROM $part)
    SELECT row_no, 'from' AS path, '"from" must not be empty' AS message FROM e WHERE p_size % 3 = 0
    UNION ALL SELECT row_no, 'kind', '"kind" must be one of {", ".join(K.EDGE_KINDS)}' FROM e WHERE p_type = 'SMALL'
    UNION ALL SELECT row_no, 'weight', 'unknown key' FROM e WHERE p_size % 5 = 0""")
def _(t):
    rows = t.sql("""SELECT p_partkey AS row_no, '{"from":"' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END || '","to":"x","kind":"'
        || CASE WHEN p_type = 'SMALL' THEN 'imports' ELSE 'import' END || '"' || CASE WHEN p_size % 5 = 0 THEN ',"weight":1' ELSE '' END || '}' AS json FROM $part""")
    return S.edge_problems(rows)


@query("n1_explode_instances", """
    SELECT scene, 0 AS pos, 'a' AS id, json_extract_string(doc, '$.instances[0].prefab') AS prefab, NULL AS parent, '{"size":2}' AS params FROM $F_scene WHERE scene % 23 <> 0
    UNION ALL SELECT scene, 1, json_extract_string(doc, '$.instances[1].id'), 'cube', json_extract_string(doc, '$.instances[1].parent'), '{}' FROM $F_scene WHERE scene % 23 <> 0""")
def _(t):
    return S.instances(t("F_scene")).drop("name")


@query("v2_document_shape", _WITH + " SELECT scene, path, message FROM shape UNION ALL SELECT scene, path, message FROM relation")
def _(t):
    return V.document_problems(t("F_scene"))


@query("v3_field_bounds", _WITH + " SELECT scene, path, message FROM shape WHERE path LIKE 'lights%' OR path LIKE 'camera%' OR path LIKE '%position'")
def _(t):
    found = V.shape_problems(t("F_scene"))
    return found.filter(F.col("path").startswith("lights") | F.col("path").startswith("camera") | F.col("path").endswith("position"))


@query("v4_unique_ids", """
    SELECT scene, 'instances[1].id' AS path, 'duplicate id "a" — first defined at instances[0]' AS message FROM $F_scene WHERE scene % 23 <> 0 AND scene % 4 = 0""")
def _(t):
    return V.duplicate_ids(S.instances(t("F_scene")), "instances")


@query("v5_parent_checks", """
    WITH RECURSIVE clean AS (SELECT id, CASE WHEN parent <> id AND parent IN (SELECT id FROM $F_tree) THEN parent END AS up FROM $F_tree),
    walk(id, cur) AS (SELECT id, up FROM clean WHERE up IS NOT NULL UNION SELECT w.id, c.up FROM walk w JOIN clean c ON c.id = w.cur WHERE c.up IS NOT NULL)
    SELECT id, problem FROM (SELECT id, CASE WHEN parent = id THEN 'self_parent' WHEN parent NOT IN (SELECT id FROM $F_tree) THEN 'missing_parent'
      WHEN id IN (SELECT id FROM walk WHERE cur IN (SELECT id FROM walk WHERE id = cur)) THEN 'cycle' END AS problem FROM $F_tree WHERE parent IS NOT NULL) p
    WHERE problem IS NOT NULL""")
def _(t):
    return V.parent_problems(t("F_tree"))


# --- edits -------------------------------------------------------------------

_BASE = "SELECT id, prefab, name, parent, locked, CAST(id AS STRING) AS position, 'r' AS rotation, 's' AS scale FROM $F_tree"
_MOVES = """SELECT event_id AS seq, user_id * 11 AS id, CASE WHEN event_id % 2 = 0 THEN 'p' || CAST(event_id AS STRING) END AS position,
      CASE WHEN event_id % 5 = 0 THEN 'q' || CAST(event_id AS STRING) END AS rotation, CAST(NULL AS STRING) AS scale FROM $events"""


@query("n2_transform_update", f"""
    WITH m AS ({_MOVES}), b AS ({_BASE}),
    l AS (SELECT id, arg_max(position, seq) FILTER (WHERE position IS NOT NULL) AS p, arg_max(rotation, seq) FILTER (WHERE rotation IS NOT NULL) AS r FROM m GROUP BY id)
    SELECT b.id AS id, coalesce(l.p, b.position) AS position, coalesce(l.r, b.rotation) AS rotation, NULL AS error FROM b LEFT JOIN l ON l.id = b.id
    UNION ALL SELECT id, NULL, NULL, 'no instance with id "' || CAST(id AS STRING) || '"' FROM m WHERE id NOT IN (SELECT id FROM b)""")
def _(t):
    moved, errors = N.set_transforms(t.sql(_BASE), t.sql(_MOVES))
    empty = F.lit(None).cast("string")
    return moved.select("id", "position", "rotation", empty.alias("error")).unionByName(
        errors.select("id", empty.alias("position"), empty.alias("rotation"), "error"))


_SWAPS = "SELECT event_id AS seq, user_id * 11 AS id, CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN 'm.png' ELSE 'm.glb' END AS model FROM $events"
_SWAPPED = f"""SELECT seq, id, model, CASE WHEN id NOT IN (SELECT id FROM $F_tree) THEN 'no instance with id "' || CAST(id AS STRING) || '"'
      WHEN trim(model) = '' THEN 'model path must not be empty' WHEN model LIKE '%.png' THEN 'wrong format' END AS error FROM ({_SWAPS}) w"""


@query("n3_model_swap", _SWAPPED)
def _(t):
    return N.swap_models(t("F_tree"), t.sql(_SWAPS), lambda m: F.when(m.endswith(".png"), "wrong format"))


@query("f1_pluggable_validator", f"SELECT error, count(*) AS n FROM (SELECT seq, CASE WHEN error LIKE 'no instance%' THEN 'no instance' ELSE error END AS error FROM ({_SWAPPED}) s) e GROUP BY error")
def _(t):
    def by_extension(model):
        return F.when(~model.endswith(".glb"), "wrong format")

    swapped = N.swap_models(t("F_tree"), t.sql(_SWAPS), by_extension)
    short = F.when(F.col("error").startswith("no instance"), "no instance").otherwise(F.col("error"))
    return swapped.groupBy(short.alias("error")).agg(F.count("*").alias("n"))


_NEW = "SELECT event_id AS seq, user_id * 1000 AS id, event_type AS prefab, 'n' AS name, CAST(NULL AS BIGINT) AS parent, false AS locked FROM $events"


@query("n4_add_instance", f"""
    WITH n AS ({_NEW}), f AS (SELECT id, min(seq) AS seq FROM n GROUP BY id)
    SELECT id, prefab, NULL AS error FROM $F_tree UNION ALL SELECT n.id, n.prefab, NULL FROM n JOIN f ON f.id = n.id AND f.seq = n.seq WHERE n.id NOT IN (SELECT id FROM $F_tree)
    UNION ALL SELECT n.id, NULL, 'instance id "' || CAST(n.id AS STRING) || '" is already used in this scene' FROM n JOIN f ON f.id = n.id WHERE n.seq > f.seq OR n.id IN (SELECT id FROM $F_tree)""")
def _(t):
    grown, errors = N.add_instances(t("F_tree"), t.sql(_NEW))
    empty = F.lit(None).cast("string")
    return grown.select("id", "prefab", empty.alias("error")).unionByName(errors.select("id", empty.alias("prefab"), "error"))


@query("n5_remove_instance", """
    WITH RECURSIVE gone AS (SELECT id, parent FROM $F_tree WHERE prefab = 'MACHINERY' AND parent <> id AND (parent < id OR parent IS NULL)),
    up(id, top, parent) AS (SELECT id, id, parent FROM gone UNION SELECT u.id, g.id, g.parent FROM up u JOIN gone g ON g.id = u.parent),
    far AS (SELECT id, coalesce(parent, top) AS target FROM up WHERE parent IS NULL OR parent NOT IN (SELECT id FROM gone))
    SELECT t.id, CASE WHEN t.parent IN (SELECT id FROM gone) THEN f.target ELSE t.parent END AS parent
    FROM $F_tree t LEFT JOIN far f ON f.id = t.parent WHERE t.id NOT IN (SELECT id FROM gone)""")
def _(t):
    removed = t("F_tree").filter("prefab = 'MACHINERY' AND parent <> id AND (parent < id OR parent IS NULL)").select("id")
    return N.remove_instances(t("F_tree"), removed).select("id", "parent")


@query("n6_merge_params", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '7' ELSE json_extract_string(params, '$.k') END AS k,
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'x' END AS z FROM $F_params""")
def _(t):
    old = F.from_json("params", "map<string,string>")
    new = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("k"), F.lit("7"))).otherwise(F.create_map(F.lit("z"), F.lit("x")))
    merged = t("F_params").select("event_id", N.merge_params(old, new, F.col("event_id") % 4 == 0).alias("m"))
    return merged.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("z")).alias("z"))


_OPS = """SELECT event_id AS seq, user_id * 11 AS id, CASE event_type WHEN 'click' THEN 'removeInstance' WHEN 'purchase' THEN 'addInstance'
      WHEN 'view' THEN 'setTransform' WHEN 'error' THEN 'teleport' ELSE 'setParams' END AS op FROM $events"""


@query("n7_edit_dispatch", f"""
    WITH o AS ({_OPS})
    SELECT seq, id, op, CASE WHEN op = 'teleport' THEN 'unknown edit' WHEN op = 'addInstance' AND present THEN 'already used'
      WHEN op <> 'addInstance' AND NOT present THEN 'no instance' END AS error FROM (
      SELECT *, coalesce(last_value(CASE op WHEN 'addInstance' THEN true WHEN 'removeInstance' THEN false END IGNORE NULLS) OVER (
        PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), id IN (SELECT id FROM $F_tree)) AS present FROM o) p""")
def _(t):
    return N.dispatch(t("F_tree"), t.sql(_OPS))


@query("n11_editability", """
    SELECT id, NOT locked AS editable, CASE WHEN locked THEN 'this instance is locked: edits are blocked until it is unlocked' ELSE '' END AS reason FROM $F_tree""")
def _(t):
    return N.editable(t("F_tree"))


@query("n12_build_failures", """
    SELECT id, 'unknown-prefab' AS kind FROM $F_tree WHERE prefab = 'MACHINERY'
    UNION ALL SELECT id, 'dangling-parent' FROM $F_tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM $F_tree)""")
def _(t):
    return N.build_failures(t("F_tree"), _prefabs(t))


def _prefabs(t):
    return t("F_tree").filter("prefab <> 'MACHINERY'").select("prefab").distinct()


@query("a8_scene_profile", "SELECT prefab, count(*) AS n, count(parent) AS parented FROM $F_tree GROUP BY prefab")
def _(t):
    return N.profile(t("F_tree"))


@query("j12_unknown_prefabs", """
    SELECT id, prefab, 'no registered prefab named "' || prefab || '"' AS message FROM $F_tree WHERE prefab = 'MACHINERY'""")
def _(t):
    return V.unknown_prefabs(t("F_tree"), _prefabs(t))


# --- parameters --------------------------------------------------------------

_SCHEMA = """SELECT DISTINCT event_type AS prefab, 'k' AS field, 'number' AS kind, CAST(10 AS DOUBLE) AS min, CAST(80 AS DOUBLE) AS max,
      event_type = 'signup' AS exclusive_min, CAST(NULL AS STRING) AS options, false AS required, CAST(NULL AS STRING) AS default_value, false AS additional
      FROM $events WHERE event_type IN ('click', 'signup', 'purchase')
    UNION ALL SELECT DISTINCT event_type, 'size', 'number', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, CAST(NULL AS STRING), true, CAST(NULL AS STRING), false
      FROM $events WHERE event_type = 'click'
    UNION ALL SELECT DISTINCT event_type, 'mode', 'string', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, 'fast,slow', true, 'fast', false
      FROM $events WHERE event_type = 'purchase'
    UNION ALL SELECT DISTINCT event_type, 'z', 'number', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, CAST(NULL AS STRING), false, '1', false
      FROM $events WHERE event_type = 'view'"""
_ROWS = "SELECT event_id AS row_id, prefab, CAST(json_extract_string(params, '$.k') AS INT) AS k FROM $F_params"
_PARAM_PROBLEMS = f"""SELECT row_id, 'k' AS field, CASE WHEN prefab = 'signup' AND k <= 10 THEN 'k must be greater than 10'
        WHEN k < 10 THEN 'k must be at least 10' ELSE 'k must be at most 80' END AS reason FROM ({_ROWS}) r
      WHERE prefab IN ('click', 'signup', 'purchase') AND (k < 10 OR k > 80 OR (prefab = 'signup' AND k = 10))
    UNION ALL SELECT row_id, 'size', 'size is required' FROM ({_ROWS}) r WHERE prefab = 'click'
    UNION ALL SELECT row_id, 'mode', 'mode is required' FROM ({_ROWS}) r WHERE prefab = 'purchase'
    UNION ALL SELECT row_id, 'k', 'Unknown parameter "k" is not allowed by schema' FROM ({_ROWS}) r WHERE prefab = 'view'"""


def _rows(t):
    return t("F_params").select(F.col("event_id").alias("row_id"), "prefab", "params")


@query("v8_parameter_validation", f"SELECT row_id, field, reason FROM ({_PARAM_PROBLEMS}) p")
def _(t):
    return V.parameter_problems(_rows(t), t.sql(_SCHEMA))


@query("v9_unknown_and_missing_params", f"""
    SELECT 'unknown' AS problem, row_id, 'k' AS field FROM ({_ROWS}) r WHERE prefab = 'view'
    UNION ALL SELECT 'missing', row_id, 'size' FROM ({_ROWS}) r WHERE prefab = 'click'""")
def _(t):
    schema = t.sql(_SCHEMA)
    unknown = V.unknown_parameters(_rows(t), schema).select(F.lit("unknown").alias("problem"), "row_id", "field")
    return unknown.unionByName(V.missing_parameters(_rows(t), schema).select(F.lit("missing").alias("problem"), "row_id", "field"))


@query("n9_effective_values", f"""
    SELECT row_id, 'k' AS field, CAST(k AS STRING) AS value FROM ({_ROWS}) r WHERE prefab IN ('click', 'signup', 'purchase')
    UNION ALL SELECT row_id, 'size', NULL FROM ({_ROWS}) r WHERE prefab = 'click'
    UNION ALL SELECT row_id, 'mode', 'fast' FROM ({_ROWS}) r WHERE prefab = 'purchase'
    UNION ALL SELECT row_id, 'z', '1' FROM ({_ROWS}) r WHERE prefab = 'view'""")
def _(t):
    return V.effective_values(_rows(t), t.sql(_SCHEMA))


@query("v10_new_problems", f"""
    SELECT DISTINCT row_id, field FROM ({_PARAM_PROBLEMS}) p WHERE field <> 'size'""")
def _(t):
    problems = V.parameter_problems(_rows(t), t.sql(_SCHEMA))
    reported = problems.filter("field = 'size'")
    return V.new_problems(problems.unionByName(problems), reported, ["row_id", "field"]).select("row_id", "field")


@query("a11_later_definitions", """
    SELECT prefab, event_id AS seq, first FROM $F_params JOIN (SELECT prefab AS p, min(event_id) AS first FROM $F_params GROUP BY prefab) m ON m.p = prefab
    WHERE event_id > first""")
def _(t):
    return V.later_definitions(t("F_params").select("prefab", F.col("event_id").alias("seq")))


_OWNED = """SELECT event_id AS seq, instance_id AS owner, CASE WHEN prefab = 'error' THEN NULL ELSE prefab END AS field,
      'r' || CAST(event_id % 3 AS STRING) AS reason FROM $F_params"""


@query("a12_grouped_problems", f"""
    WITH o AS ({_OWNED}) SELECT owner, field, arg_max(reason, seq) AS reason FROM o WHERE field IS NOT NULL GROUP BY owner, field
    UNION ALL SELECT owner, NULL, string_agg(reason, ' ' ORDER BY seq) FROM (
      SELECT owner, reason, min(seq) AS seq FROM o WHERE field IS NULL GROUP BY owner, reason) g GROUP BY owner""")
def _(t):
    return V.grouped_problems(t.sql(_OWNED))


@query("a15_collected_problems", """
    SELECT text, min(scope) AS scope FROM (SELECT 'prefab ' || prefab || ' failed to load' AS text, 'project' AS scope FROM $F_tree WHERE locked
      UNION ALL SELECT 'no registered prefab named "' || prefab || '"', 'instance' FROM $F_tree WHERE prefab = 'MACHINERY'
      UNION ALL SELECT 'dangling parent of ' || CAST(id AS STRING), 'instance' FROM $F_tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM $F_tree)) u GROUP BY text""")
def _(t):
    tree = t("F_tree")
    failed = tree.filter("locked").select(F.lit("project").alias("scope"), F.concat(F.lit("prefab "), "prefab", F.lit(" failed to load")).alias("text"))
    unknown = V.unknown_prefabs(tree, _prefabs(t)).select(F.lit("instance").alias("scope"), F.col("message").alias("text"))
    dangling = N.build_failures(tree, _prefabs(t)).filter("kind = 'dangling-parent'").select(
        F.lit("instance").alias("scope"), F.concat(F.lit("dangling parent of "), F.col("id").cast("string")).alias("text"))
    return V.collected_problems(failed, unknown, dangling)


@query("a16_scoped_problems", """
    SELECT event_id FROM $F_params WHERE (prefab <> 'error' AND prefab <> 'view' AND instance_id = 8) OR (prefab = 'view' AND instance_id = 8)
      OR (prefab = 'error' AND event_id % 2 = 0) OR (prefab = 'error' AND event_id % 2 = 1 AND instance_id = 8)""")
def _(t):
    plain = F.col("prefab") == "error"
    named = F.concat(F.lit('instance "'), F.col("instance_id").cast("string"), F.lit('" is broken'))
    rows = t("F_params").select(
        "event_id", F.when(plain, "text").when(F.col("prefab") == "view", "field").otherwise("instance").alias("scope"),
        F.when(~plain, F.col("instance_id").cast("string")).alias("instance_id"),
        F.when(plain & (F.col("event_id") % 2 == 1), named).otherwise("must be finite").alias("text"))
    return V.scoped_problems(rows, "8").select("event_id")


# --- slots -------------------------------------------------------------------



def _expected():
    return F.struct(F.lit("reg").alias("slot"), F.lit("glb").alias("format"), F.array(F.lit("idle"), F.lit("walk")).alias("animations"),
                    F.lit(None).cast("string").alias("dimensions"), F.lit(True).alias("rigged"), F.lit(2000.0).alias("max_size_kb"))


@query("v6_slot_compatibility", f"""
    WITH q AS ({SLOTS_SQL})
    SELECT asset_id, 'file_not_found' AS kind, 'an existing file' AS expectation FROM q WHERE asset_id % 17 = 0
    UNION ALL SELECT asset_id, 'wrong_slot_type', 'slot "reg"' FROM q WHERE asset_id % 17 <> 0 AND slot <> 'reg'
    UNION ALL SELECT asset_id, 'wrong_slot_type', 'format "glb"' FROM q WHERE asset_id % 17 <> 0 AND format <> 'glb'
    UNION ALL SELECT asset_id, 'missing_rig', 'a rigged model with a skeleton and skin' FROM q WHERE asset_id % 17 <> 0 AND rigged IS DISTINCT FROM true
    UNION ALL SELECT asset_id, 'missing_animation', 'animation "' || a || '"' FROM q, (SELECT 'idle' AS a UNION ALL SELECT 'walk') n
      WHERE asset_id % 17 <> 0 AND NOT coalesce(contains(animations, a), false)
    UNION ALL SELECT asset_id, 'exceeds_max_size', 'at most 2000 KB' FROM q WHERE asset_id % 17 <> 0 AND size_kb > 2000""")
def _(t):
    size = F.when(F.col("asset_id") % 17 != 0, F.col("size_kb"))
    return resolved_slots(t).select("asset_id", F.inline(V.slot_rejections(F.col("path"), size, F.col("slot"), _expected())))


@query("v7_has_expectations", f"""
    SELECT asset_id, source IN ('companion', 'registry', 'hint') AS asks FROM ({SLOTS_SQL}) q""")
def _(t):
    return resolved_slots(t).select("asset_id", V.has_expectations(F.col("slot"), F.col("path")).alias("asks"))


# --- seeded draws ------------------------------------------------------------

_HASH = """list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS HUGEINT))),
      lambda h, c: (xor(h, c) * 16777619) % 4294967296)"""


@query("r1_key_hash", f"SELECT id, CAST({_HASH} AS BIGINT) AS hash FROM $F_nodes")
def _(t):
    return t("F_nodes").select("id", R.key_hash(F.col("id")).alias("hash"))


_M = 4294967296
_STREAM = f"""SELECT id, n, u / 4294967296.0 AS value FROM (SELECT id, n, xor(t2, t2 // 16384) AS u FROM (
    SELECT id, n, xor(t1, (t1 + (xor(t1, t1 // 128) * CAST(t1 | 61 AS HUGEINT)) % {_M}) % {_M}) AS t2 FROM (
      SELECT id, n, (xor(s, s // 32768) * CAST(s | 1 AS HUGEINT)) % {_M} AS t1 FROM (
        SELECT id, n, (xor((CAST(77 AS HUGEINT) * 2654435761) % {_M}, h) + CAST(n AS HUGEINT) * 1831565813) % {_M} AS s FROM (
          SELECT id, {_HASH} AS h, unnest([1, 2, 3]) AS n FROM $F_nodes) a) b) c) d) e"""


@query("r2_seeded_stream", f"SELECT id, n, value FROM ({_STREAM}) s")
def _(t):
    values = R.draws(R.stream_seed(F.lit(77), F.col("id")), 3)
    return t("F_nodes").select("id", F.posexplode(values).alias("i", "value")).select("id", (F.col("i") + 1).alias("n"), "value")


@query("r3_derived_draws", f"""
    SELECT id, -5 + value * 15 AS ranged, 3 + CAST(floor(value * 8) AS BIGINT) AS whole,
      ['a', 'b', 'c'][CAST(least(floor(value * 3), 2) AS INT) + 1] AS picked, value < 0.25 AS lucky FROM ({_STREAM}) s WHERE n = 1""")
def _(t):
    value = F.col("v")
    rows = t("F_nodes").select("id", R.draw(R.stream_seed(F.lit(77), F.col("id")), F.lit(1)).alias("v"))
    return rows.select("id", R.in_range(value, -5, 10).alias("ranged"), R.whole(value, 3, 10).alias("whole"),
                       R.pick(value, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("picked"), R.chance(value, 0.25).alias("lucky"))
