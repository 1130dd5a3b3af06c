"""Patch, diff and history queries."""

from pyspark.sql import functions as F

from corpusgraph.catalog.fixtures import query
from corpusgraph.functions import edits as E
from corpusgraph.functions import paths as P
from corpusgraph.functions.exprs import joined
from corpusgraph.operators import diffs as D
from corpusgraph.operators import history as H
from corpusgraph.operators import patches as A
from corpusgraph.operators import replies

_COUNT = "CASE WHEN find = '' THEN 0 ELSE CAST((length(content) - length(replace(content, find, ''))) / length(find) AS INT) END"


@query("d1_exact_occurrences", f"SELECT doc_id, {_COUNT} AS n FROM $F_edits")
def _(t):
    return t("F_edits").select("doc_id", E.occurrences(F.col("content"), F.col("find")).alias("n"))


@query("d2_snippet_location", f"""
    SELECT doc_id, n = 1 AS ok, n AS occurrences, CASE WHEN trim(find) = '' THEN 'empty' ELSE 'exact' END AS how,
      CASE WHEN trim(find) = '' THEN 'FIND is empty, so there is nothing to locate' WHEN n > 1 THEN 'matched ' || CAST(n AS STRING) || ' times' END AS reason
    FROM (SELECT doc_id, find, CASE WHEN trim(find) = '' THEN 0 ELSE {_COUNT} END AS n FROM $F_edits) c""")
def _(t):
    found = A.locate_snippets(t("F_edits"))
    return found.select("doc_id", "m.ok", "m.occurrences", "m.how", "m.reason")


_WINDOW = """SELECT e.doc_id, f.i AS start_line, count(*) AS k FROM (
      SELECT doc_id, ls, trim(ls[2]) AS a, trim(ls[3]) AS b FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM $F_edits) x WHERE len(ls) >= 3) e
    JOIN (SELECT doc_id, generate_subscripts(ls, 1) AS i, trim(unnest(ls)) AS s, trim(unnest(list_append(ls[2:], NULL))) AS nxt FROM (
      SELECT doc_id, string_split(content, chr(10)) AS ls FROM $F_edits) y) f ON f.doc_id = e.doc_id AND f.s = e.a AND f.nxt = e.b
    GROUP BY e.doc_id, f.i"""


def _pairs(t):
    """Lines two and three of each document, indented, against the document."""
    lines = F.split("content", "\n", -1)
    rows = t("F_edits").filter(F.size(lines) >= 3).select("doc_id", "content", lines.alias("f"))
    return rows.withColumn("s", F.transform(F.slice("f", 2, 2), lambda x: F.concat(F.lit("   "), x)))


@query("d3_line_window_match", f"SELECT doc_id, start_line FROM ({_WINDOW}) w")
def _(t):
    spans = E.line_windows(F.col("f"), F.col("s"), lambda x: F.regexp_replace(x, r"^ +| +$", ""))
    return _pairs(t).select("doc_id", F.explode(spans).alias("p")).select("doc_id", (F.col("p.start") + 1).alias("start_line"))


@query("d4_blank_line_drift", """
    SELECT doc_id, count(*) AS hits FROM (SELECT e.doc_id FROM (
        SELECT doc_id, ks[2] AS a, ks[3] AS b, ks FROM (SELECT doc_id, list_filter(list_transform(string_split(content, chr(10)), lambda s:
          trim(regexp_replace(regexp_replace(s, '\\s*([(){}\\[\\];,:=<>+\\-*/])\\s*', '\\1', 'g'), '\\s+', ' ', 'g'))), lambda s: s <> '') AS ks FROM $F_edits) x
        WHERE len(ks) >= 3) e, (SELECT unnest(range(1, 20000)) AS i) r
      WHERE r.i < len(e.ks) AND e.ks[r.i] = e.a AND e.ks[r.i + 1] = e.b) h GROUP BY doc_id""")
def _(t):
    from corpusgraph.functions import text as T
    keyed = t("F_edits").select("doc_id", F.split("content", "\n", -1).alias("f")).withColumn(
        "k", F.filter("f", lambda x: T.collapse_whitespace(x) != ""))
    rows = keyed.filter(F.size("k") >= 3).withColumn("s", F.array(F.get("k", F.lit(1)), F.lit(""), F.lit("  "), F.get("k", F.lit(2))))
    return rows.select("doc_id", F.explode(E.across_blank_lines(F.col("f"), F.col("s")))).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("d5_boundary_anchor")
def _(t):
    spans = E.boundary_anchor(F.col("f"), F.col("s"))
    rows = t("F_edits").select("doc_id", F.split("content", "\n", -1).alias("f")).filter(F.size("f") >= 5)
    rows = rows.withColumn("s", F.array(F.get("f", F.lit(1)), F.get("f", F.lit(2)), F.get("f", F.lit(4))))
    return rows.select("doc_id", F.inline(spans))


@query("d6_variable_anchor", """
    SELECT file_id, 5 AS start, 6 AS "end" FROM $F_code""")
def _(t):
    source = F.regexp_replace("content", "export const", "const")
    rows = t("F_code").select("file_id", F.split(source, "\n", -1).alias("f"))
    wanted = F.transform(F.slice("f", 6, 2), lambda s: F.regexp_replace(s, " ", "  "))
    return rows.select("file_id", F.inline(E.variable_anchor(F.col("f"), wanted)))


@query("d7_span_dedupe", f"SELECT doc_id, count(DISTINCT start_line) AS spans FROM ({_WINDOW}) w GROUP BY doc_id")
def _(t):
    spans = E.line_windows(F.col("f"), F.col("s"), lambda x: F.regexp_replace(x, r"^ +| +$", ""))
    doubled = _pairs(t).select("doc_id", F.explode(F.concat(spans, spans)).alias("p"))
    return doubled.dropDuplicates(["doc_id", "p"]).groupBy("doc_id").agg(F.count("*").alias("spans"))


def _applied(t):
    files = t("F_edits").select("path", "content")
    return A.apply_replies(t("F_edit_replies"), files)


@query("d8_batch_edits", f"""
    SELECT doc_id AS reply_id, path, CASE WHEN n = 1 THEN 'applied' WHEN contains(content, replace) THEN 'already' ELSE 'failed' END AS status,
      CASE WHEN n = 1 THEN md5(replace(content, find, replace)) ELSE md5(content) END AS digest
    FROM (SELECT *, CASE WHEN trim(find) = '' THEN 0 ELSE {_COUNT} END AS n FROM $F_edits) c""")
def _(t):
    return _applied(t).select("reply_id", "path", F.get("results", F.lit(0))["status"].alias("status"), F.md5("after").alias("digest"))


@query("d9_already_applied", """
    SELECT doc_id, (replace <> '' AND contains(content, replace)) OR (length(trim(replace)) > 10 AND contains(content, trim(replace))) AS already
    FROM (SELECT doc_id, content, CASE WHEN doc_id % 2 = 0 THEN find ELSE replace END AS replace FROM $F_edits) e""")
def _(t):
    picked = F.when(F.col("doc_id") % 2 == 0, F.col("find")).otherwise(F.col("replace"))
    return t("F_edits").select("doc_id", E.already_there(F.col("content"), picked).alias("already"))


@query("d10_block_overlap", """
    SELECT doc_id, contains(b, a) OR contains('X: ' || a || '!', b) OR list_has_any(
      list_filter(list_transform(string_split(a, chr(10)), lambda s: trim(s)), lambda s: length(s) >= 12),
      list_filter(list_transform(string_split(b, chr(10)), lambda s: trim(s)), lambda s: length(s) >= 12)) AS clash
    FROM (SELECT doc_id, find AS a, split_part(content, chr(10), 3) AS b FROM $F_edits) e""")
def _(t):
    rows = t("F_edits").select("doc_id", F.col("find").alias("a"), F.split_part("content", F.lit("\n"), F.lit(3)).alias("b"))
    return rows.select("doc_id", E.overlaps(F.col("a"), F.concat(F.lit("X: "), "a", F.lit("!")), F.col("b")).alias("clash"))


def _two_blocks(t):
    """Two blocks per document: lines two and three; every third document undoes the first."""
    second = F.split_part("content", F.lit("\n"), F.lit(3))
    blocks = F.array(
        F.struct(F.col("find").alias("find"), F.col("replace").alias("replace")),
        F.struct(second.alias("find"), F.when(F.col("doc_id") % 3 == 0, F.concat("replace", F.lit(" "), "find")).otherwise(
            F.concat(F.lit("Y "), second)).alias("replace")))
    return A.apply_blocks(t("F_edits").select("doc_id", F.col("content").alias("base"), blocks.alias("edits")))


@query("d11_net_reversal")
def _(t):
    return _two_blocks(t).select("doc_id", F.inline("results"))


@query("d12_restored_layout", """
    SELECT doc_id, '  X' || chr(13) || chr(10) || chr(13) || chr(10) || '  Y' AS text FROM $F_edits""")
def _(t):
    target = F.concat(F.lit("  "), F.regexp_replace("find", r"[\r\n]", ""), F.lit("a\r\n\r\n  b"))
    return t("F_edits").select("doc_id", E.fitted(F.lit("X\nY"), target, F.concat(target, F.lit("\r\n"))).alias("text"))


_PLAN = """SELECT reply_id, CASE WHEN path LIKE '%..%' THEN 1 ELSE 0 END AS refused,
      CASE WHEN path LIKE '%.json' AND NOT json_valid(body) THEN 1 ELSE 0 END AS bad, path, body FROM (
      SELECT reply_id, regexp_extract(reply, 'FILE: (\\S+)', 1) AS path,
        regexp_extract(reply, '(?s)```\\n(.*?)\\n```', 1) AS body FROM $F_replies) r"""


def _known(t):
    return t.sql("""SELECT 'src/' || CAST(conv_id % 40 AS STRING) || '.js' AS path, max(text) AS content
                    FROM $conversations WHERE role = 'assistant' AND turn % 3 = 1 GROUP BY 1""")


_KNOWN = """SELECT 'src/' || CAST(conv_id % 40 AS STRING) || '.js' AS path, max(text) AS content
            FROM $conversations WHERE role = 'assistant' AND turn % 3 = 1 GROUP BY 1"""


@query("d13_reply_gate", f"""
    SELECT reply_id, CASE WHEN refused = 1 THEN 'refused_path' WHEN bad = 1 THEN 'syntax' WHEN body = content THEN 'no_change' ELSE 'pass' END AS verdict,
      refused = 0 AND bad = 1 AS can_override FROM ({_PLAN}) p LEFT JOIN ({_KNOWN}) k ON k.path = p.path""")
def _(t):
    return A.gate(A.plan_totals(A.apply_replies(t("F_replies"), _known(t))))


@query("d14_patch_preview", f"""
    SELECT reply_id, p.path, md5(k.content) AS before, CASE WHEN refused = 0 THEN md5(body) END AS after,
      refused = 0 AND (k.content IS NULL OR k.content <> body) AS changed, refused = 0 AND k.content IS NULL AS created, bad = 1 AS bad_syntax
    FROM ({_PLAN}) p LEFT JOIN ({_KNOWN}) k ON k.path = p.path""")
def _(t):
    return A.apply_replies(t("F_replies"), _known(t)).select(
        "reply_id", "path", F.md5("before").alias("before"), F.md5("after").alias("after"), "changed", "created",
        F.col("syntax").isNotNull().alias("bad_syntax"))


@query("d15_patch_apply", f"""
    SELECT k.path, md5(coalesce(n.body, k.content)) AS digest FROM ({_KNOWN}) k FULL JOIN (
      SELECT path, arg_max(body, reply_id) AS body FROM ({_PLAN}) p WHERE path LIKE '%.js' AND refused = 0 GROUP BY path) n ON n.path = k.path
    WHERE k.path IS NOT NULL UNION ALL
    SELECT path, md5(arg_max(body, reply_id)) FROM ({_PLAN}) p WHERE refused = 0 AND bad = 0 AND path NOT IN (SELECT path FROM ({_KNOWN}) k) GROUP BY path""")
def _(t):
    files = _known(t)
    changes = A.passing_changes(A.apply_replies(t("F_replies"), files))
    last = changes.groupBy("path").agg(F.max_by("after", "reply_id").alias("after"), F.max("reply_id").alias("reply_id"))
    # A later reply that restores the stored text is no change, yet it is the last word.
    same = A.apply_replies(t("F_replies"), files).filter("NOT changed AND refusal IS NULL").groupBy("path").agg(F.max("reply_id").alias("same_id"))
    live = last.join(same, "path", "left").filter("same_id IS NULL OR same_id < reply_id").select("path", "after")
    return A.next_version(files, live).select("path", F.md5("content").alias("digest"))


@query("d16_new_project_check", f"""
    SELECT reply_id, CASE WHEN refused = 1 THEN 'path' WHEN bad = 1 THEN 'syntax' END AS refusal, 1 AS files FROM ({_PLAN}) p""")
def _(t):
    return A.new_project_check(t("F_replies"))


@query("a13_patch_totals", f"""
    SELECT reply_id, 1 AS blocks, 0 AS applied, 0 AS already, 0 AS failed,
      CASE WHEN refused = 0 AND (k.content IS NULL OR k.content <> body) THEN 1 ELSE 0 END AS changed,
      CASE WHEN refused = 0 AND k.content IS NULL THEN 1 ELSE 0 END AS created, refused
    FROM ({_PLAN}) p LEFT JOIN ({_KNOWN}) k ON k.path = p.path""")
def _(t):
    return A.plan_totals(A.apply_replies(t("F_replies"), _known(t))).drop("syntax")


@query("s16_reply_sink", f"SELECT reply_id, path, md5(body) AS digest FROM ({_PLAN}) p WHERE refused = 0 AND bad = 0")
def _(t):
    import uuid
    from corpusgraph.session import checkpoint_folder
    place = f"{checkpoint_folder(t.spark).rstrip('/')}/corpusgraph/new-{uuid.uuid4().hex}"
    A.write_new_projects(t("F_replies"), place)
    written = t.spark.read.schema("path string, content string, reply_id bigint").parquet(place)
    return written.select("reply_id", "path", F.md5("content").alias("digest"))


@query("v1_json_validity", f"SELECT reply_id, path, bad = 1 AS invalid FROM ({_PLAN}) p")
def _(t):
    blocks = replies.file_block_rows(t("F_replies"))
    return blocks.select("reply_id", "path", A.syntax_failure(F.col("path"), F.col("content")).isNotNull().alias("invalid"))


@query("f4_group_fold")
def _(t):
    return _two_blocks(t).select("doc_id", F.md5("content").alias("digest"), F.size("applied").alias("applied"))


# --- diffs -------------------------------------------------------------------

_NET = """SELECT doc_id, line, sum(w) AS w FROM (
      SELECT doc_id, unnest(string_split(CASE WHEN after LIKE '%' || chr(10) THEN left(after, length(after) - 1) ELSE after END, chr(10))) AS line, 1 AS w FROM $F_versions
      UNION ALL SELECT doc_id, unnest(string_split(CASE WHEN before LIKE '%' || chr(10) THEN left(before, length(before) - 1) ELSE before END, chr(10))), -1 FROM $F_versions) u
    GROUP BY doc_id, line"""


@query("d17_line_multiset_diff", f"""
    SELECT doc_id, sum(greatest(w, 0)) AS added, sum(greatest(-w, 0)) AS removed FROM ({_NET}) n GROUP BY doc_id
    HAVING sum(abs(w)) > 0""")
def _(t):
    return D.multiset_diff(t("F_versions"), "doc_id")


@query("d18_line_diff")
def _(t):
    return D.operation_rows(D.line_diff(t("F_versions")), "doc_id")


@query("d18_diff_replay", """
    SELECT doc_id, md5(CASE WHEN before LIKE '%' || chr(10) THEN left(before, length(before) - 1) ELSE before END) AS before_digest,
      md5(CASE WHEN after LIKE '%' || chr(10) THEN left(after, length(after) - 1) ELSE after END) AS after_digest FROM $F_versions""")
def _(t):
    diffed = D.line_diff(t("F_versions"))
    side = lambda other: F.md5(F.array_join(F.transform(
        F.filter("ops", lambda o: o["type"] != other), lambda o: o["line"]), "\n"))
    return diffed.select("doc_id", side("add").alias("before_digest"), side("delete").alias("after_digest"))


@query("d19_hunks")
def _(t):
    return D.hunk_rows(D.line_diff(t("F_versions")), "doc_id")


@query("d20_unified_diff")
def _(t):
    diffed = D.render(D.line_diff(t("F_versions")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return diffed.filter("diff <> ''").select("doc_id", "diff")


@query("d21_change_detection", """
    SELECT doc_id, before, after FROM $F_versions WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND before <> after
    UNION ALL SELECT doc_id, NULL, after FROM $F_versions WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0
    UNION ALL SELECT doc_id, before, NULL FROM $F_versions WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0""")
def _(t):
    rows = t("F_versions")
    old = rows.filter("doc_id % 7 <> 0").select("doc_id", F.col("before").alias("content"))
    new = rows.filter("doc_id % 5 <> 0").select("doc_id", F.col("after").alias("content"))
    return D.changed_files(old, new, ["doc_id"])


# --- history -----------------------------------------------------------------

_STEPS = """SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, event_id) AS step FROM $F_log WHERE before IS DISTINCT FROM after"""


@query("h1_record_steps", f"""
    SELECT project, event_id, step, 'PATCH #' || CASE WHEN step < 1000 THEN lpad(CAST(step AS STRING), 3, '0') ELSE CAST(step AS STRING) END AS patch_id,
      'Modified 1 file' AS description FROM ({_STEPS}) s""")
def _(t):
    return H.record_steps(t("F_log")).select("project", "event_id", "step", "patch_id", "description")


@query("h2_retention", f"""
    SELECT project, event_id, rn FROM (SELECT project, event_id, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS rn
      FROM ({_STEPS}) s) r WHERE rn <= 20""")
def _(t):
    return H.retained(H.record_steps(t("F_log")), 20).select("project", "event_id", "rn")


_REPLAY = """WITH RECURSIVE a AS (SELECT project, event_id, action, row_number() OVER (PARTITION BY project ORDER BY ts, event_id) AS n FROM $F_actions),
    s(project, n, event_id, ok, undo, redo) AS (
      SELECT DISTINCT project, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM a
      UNION ALL SELECT s.project, a.n, a.event_id,
        CASE a.action WHEN 'record' THEN true WHEN 'undo' THEN len(undo) > 0 ELSE len(redo) > 0 END,
        CASE a.action WHEN 'record' THEN CASE WHEN len(undo) >= 20 THEN list_append(undo[2:], a.event_id) ELSE list_append(undo, a.event_id) END
          WHEN 'undo' THEN undo[1:len(undo) - 1] ELSE CASE WHEN len(redo) > 0 THEN list_append(undo, redo[len(redo)]) ELSE undo END END,
        CASE a.action WHEN 'record' THEN CAST([] AS BIGINT[]) WHEN 'undo' THEN CASE WHEN len(undo) > 0 THEN list_append(redo, undo[len(undo)]) ELSE redo END
          ELSE redo[1:len(redo) - 1] END
      FROM s JOIN a ON a.project = s.project AND a.n = s.n + 1)"""


@query("h3_undo_redo_replay", _REPLAY + """
    SELECT project, event_id, ok, len(undo) AS undo_count, len(redo) AS redo_count FROM s WHERE n > 0""")
def _(t):
    return H.replay(t("F_actions"), 20).select("project", "event_id", "ok", "undo_count", "redo_count")


@query("h5_history_status", _REPLAY + """
    SELECT project, len(undo) > 0 AS can_undo, len(redo) > 0 AS can_redo, len(undo) AS undo_count, len(redo) AS redo_count,
      undo[len(undo)] AS next_undo, redo[len(redo)] AS next_redo,
      array_to_string(list_transform(undo[greatest(1, len(undo) - 4):], lambda x: CAST(x AS STRING)), ',') AS recent
    FROM (SELECT *, max(n) OVER (PARTITION BY project) AS last FROM s) f WHERE n = last""")
def _(t):
    return H.status(H.replay(t("F_actions"), 20))


@query("h4_conflicts", f"""
    WITH st AS ({_STEPS}), cur AS (SELECT project, path, arg_max(event_id, step) AS e FROM st GROUP BY project, path),
    now AS (SELECT c.project, c.path, s.after AS content FROM cur c JOIN st s ON s.event_id = c.e WHERE s.after IS NOT NULL)
    SELECT st.project, st.step, st.path FROM st LEFT JOIN now ON now.project = st.project AND now.path = st.path
    WHERE now.content IS DISTINCT FROM st.after""")
def _(t):
    steps = H.record_steps(t("F_log"))
    return H.conflicts(steps, H.state_as_of(steps, 1_000_000_000))


@query("h6_state_as_of_step", f"""
    WITH st AS (SELECT * FROM ({_STEPS}) s WHERE step <= 12)
    SELECT s.project, s.path, s.after AS content FROM st s JOIN (SELECT project, path, max(step) AS step FROM st GROUP BY project, path) m
      ON m.project = s.project AND m.path = s.path AND m.step = s.step WHERE s.after IS NOT NULL""")
def _(t):
    return H.state_as_of(H.record_steps(t("F_log")), 12)


@query("h7_step_description", """
    SELECT step, 'Patch: ' || files || CASE WHEN n > 3 THEN ' +' || CAST(n - 3 AS STRING) || ' more' ELSE '' END AS description FROM (
      SELECT step, max(n) AS n, string_agg(path, ', ' ORDER BY path) FILTER (WHERE rn <= 3) AS files FROM (
        SELECT project AS step, path, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY path) AS rn
        FROM (SELECT DISTINCT project, path FROM $F_log) d) r GROUP BY step) g""")
def _(t):
    return H.describe_steps(t("F_log").select(F.col("project").alias("step"), "path").distinct(), shown=3)


@query("h8_clear_history", """
    SELECT event_id, '/p/' || CAST(project AS STRING) AS project FROM $F_log WHERE project NOT IN (SELECT c_custkey FROM $customer WHERE c_custkey % 3 = 0)""")
def _(t):
    raw = F.concat(F.lit('  "/p/'), "project", F.lit('" '))
    gone = t.table("customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("/p/"), "c_custkey").alias("project"))
    kept = H.clear(t("F_log").select("event_id", raw.alias("project")), gone)
    return kept.select("event_id", P.normalize_project_key(F.col("project")).alias("project"))


@query("w12_last_entries", f"""
    SELECT project, event_id, rn FROM (SELECT project, event_id, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS rn
      FROM ({_STEPS}) s) r WHERE rn <= 5""")
def _(t):
    return H.newest(H.record_steps(t("F_log")), 5).select("project", "event_id", "rn")


@query("w14_recent_keys", """
    SELECT project, path, rn FROM (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS rn FROM (
      SELECT project, path, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM $F_log GROUP BY project, path) m) r WHERE rn <= 4""")
def _(t):
    return H.recent_keys(t("F_log"), "path", 4)
