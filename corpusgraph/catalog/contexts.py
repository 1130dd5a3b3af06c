"""Ranking and context queries."""

from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.catalog.fixtures import query
from corpusgraph.catalog.paths import quoted
from corpusgraph.catalog.text import REFERENCES
from corpusgraph.functions import text as T
from corpusgraph.operators import context as C
from corpusgraph.operators import ranking as R
from corpusgraph.plans.loops import cut

_STOP = quoted(K.STOP_WORDS)
_WORDS = f"""words AS (SELECT query_id, project, w, min(i) AS pos FROM (
      SELECT query_id, project, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT query_id, project,
        list_filter(regexp_split_to_array(lower(issue), '[^a-z0-9_.-]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS ws
        FROM $F_issues) a) b GROUP BY query_id, project, w),
    syms AS (SELECT DISTINCT query_id, project, s FROM (SELECT query_id, project, unnest(list_transform(
      regexp_extract_all(issue, '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\b', 1), lambda x: lower(x))) AS s FROM $F_issues) u
      WHERE length(s) >= 3 AND s NOT IN ({_STOP})),
    refs AS ({REFERENCES.replace("{table}", "$F_issues")}),
    logr AS (SELECT r.query_id, i.project, r.file, CASE WHEN ord = 0 THEN 100 ELSE 95 END AS score, line,
      CASE WHEN ord = 0 THEN CASE WHEN line IS NULL THEN 'Primary error location' ELSE 'Error origin at line ' || CAST(line AS STRING) END
        ELSE CASE WHEN line IS NULL THEN 'Active stack frame' ELSE 'Stack frame at line ' || CAST(line AS STRING) END END AS reason, 1 AS k, ord AS a, 0 AS b
      FROM refs r JOIN $F_issues i ON i.query_id = r.query_id JOIN $F_contracts f ON f.project = i.project AND f.path = r.file),
    namer AS (SELECT w.query_id, w.project, f.path AS file, 40 AS score, CAST(NULL AS BIGINT) AS line, 'Filename matches "' || w || '"' AS reason, 2 AS k, pos - 1 AS a, 0 AS b
      FROM words w JOIN $F_contracts f ON f.project = w.project AND contains(lower(f.path), w)),
    decl AS (SELECT project, path, nullif(regexp_extract(export_sig, '^(?:function |class |const )?([A-Za-z_$][A-Za-z0-9_$]*)', 1), '') AS d, 3 AS k FROM $F_contracts
      UNION ALL SELECT project, path, nullif(regexp_extract(signal_sig, '^([^(]*)', 1), ''), 4 FROM $F_contracts),
    symr AS (SELECT s.query_id, s.project, d.path AS file, 80 AS score, CAST(NULL AS BIGINT) AS line,
      CASE WHEN k = 3 THEN 'Exports "' ELSE 'Declares signal "' END || d || '", named in your description' AS reason, k, 0 AS a, 0 AS b
      FROM syms s JOIN decl d ON d.project = s.project AND lower(d.d) = s.s),
    links AS (SELECT DISTINCT project, src, dst FROM $F_deps),
    top AS (SELECT query_id, project, file, min(a) AS a FROM logr GROUP BY query_id, project, file),
    near AS (SELECT t.query_id, t.project, l.dst AS file, 75 AS score, CAST(NULL AS BIGINT) AS line, 'Direct dependency of ' || t.file AS reason, 5 AS k, a, 0 AS b
      FROM top t JOIN links l ON l.project = t.project AND l.src = t.file
      UNION ALL SELECT t.query_id, t.project, l.src, 70, NULL, 'Dependent of ' || t.file || ' — it may need updating too', 5, a, 1
      FROM top t JOIN links l ON l.project = t.project AND l.dst = t.file),
    hits AS (SELECT * FROM logr UNION ALL SELECT * FROM namer UNION ALL SELECT * FROM symr UNION ALL SELECT * FROM near),
    once AS (SELECT query_id, project, file, reason, max(score) AS score, min(k * 1000000 + a * 10 + b) AS seq FROM hits GROUP BY query_id, project, file, reason),
    ranked AS (SELECT o.query_id, o.project, o.file, max(o.score) AS score, any_value(l.line) AS line,
      string_agg(o.reason, '; ' ORDER BY o.seq) AS reason, max(o.score) >= 95 AS is_top FROM once o LEFT JOIN (
        SELECT query_id, file, arg_min(line, a) AS line FROM logr WHERE line IS NOT NULL GROUP BY query_id, file) l
      ON l.query_id = o.query_id AND l.file = o.file GROUP BY o.query_id, o.project, o.file),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS place FROM ranked),
    asked AS (SELECT DISTINCT query_id, project, f AS path FROM (SELECT query_id, project,
      unnest(regexp_extract_all(logs, '(?i)\\bNEED:\\s*([^\\s—\\n]+)', 1)) AS f FROM $F_issues) u)"""


def _files(t):
    return t("F_contracts").select("project", "path")


def _ranked(t):
    return R.rank(t("F_issues"), _files(t), t("F_contracts"), t("F_deps"))


@query("w1_relevance_ranking", f"""WITH {_WORDS}
    SELECT query_id, project, file, score, line, reason, is_top FROM ranked""")
def _(t):
    return _ranked(t)


@query("w2_log_reference_rule", f"""WITH {_WORDS} SELECT query_id, file, score, line, reason FROM logr""")
def _(t):
    return R.log_rule(t("F_issues"), _files(t)).select("query_id", "file", "score", "line", "reason")


@query("w3_name_token_rule", f"WITH {_WORDS} SELECT query_id, file, score, reason FROM namer")
def _(t):
    return R.name_rule(t("F_issues"), _files(t)).select("query_id", "file", "score", "reason")


@query("w4_exported_symbol_rule", f"WITH {_WORDS} SELECT query_id, file, score, reason FROM symr")
def _(t):
    return R.symbol_rule(t("F_issues"), t("F_contracts")).select("query_id", "file", "score", "reason")


@query("w5_neighbour_rule", f"WITH {_WORDS} SELECT query_id, file, score, reason FROM near")
def _(t):
    return R.neighbour_rule(R.log_rule(t("F_issues"), _files(t)), t("F_deps")).select("query_id", "file", "score", "reason")


@query("w6_top_files_per_issue", f"""WITH {_WORDS}
    SELECT query_id, file, score, place FROM placed p WHERE place BETWEEN 2 AND 6
      AND NOT EXISTS (SELECT 1 FROM asked a WHERE a.query_id = p.query_id AND a.path = p.file)""")
def _(t):
    return R.attachments(t("F_issues"), _ranked(t)).select("query_id", "file", "score", "place")


@query("w13_target_choice", f"""WITH {_WORDS}
    SELECT i.query_id, p.file AS target, p.line FROM $F_issues i LEFT JOIN placed p ON p.query_id = i.query_id AND place = 1""")
def _(t):
    return R.targets(t("F_issues"), _ranked(t)).select("query_id", "target", "line")


@query("w11_signature_order", """
    SELECT c.project, path, CASE WHEN path = first THEN 0 ELSE 1 END AS later, export_sig
    FROM $F_contracts c JOIN (SELECT project, min(path) AS first FROM $F_sources GROUP BY project) f ON f.project = c.project""")
def _(t):
    first = t("F_sources").groupBy("project").agg(F.min("path").alias("path"))
    return R.signature_order(t("F_contracts"), first).select("project", "path", "later", "export_sig")


@query("a6_silent_nodes", "SELECT project, count(*) FILTER (WHERE export_sig = '' AND signal_sig = '') AS silent FROM $F_contracts GROUP BY project")
def _(t):
    return t("F_contracts").groupBy("project").agg(
        F.count_if((F.col("export_sig") == "") & (F.col("signal_sig") == "")).alias("silent"))


@query("u3_described_and_exported", f"""WITH {_WORDS}
    SELECT DISTINCT s.query_id, s.s AS symbol FROM syms s JOIN decl d ON d.project = s.project AND lower(d.d) = s.s""")
def _(t):
    return R.described_exports(t("F_issues"), t("F_contracts")).select("query_id", "symbol").distinct()


@query("f2_existence_table", f"""WITH {_WORDS}
    SELECT r.query_id, r.file, r.line FROM refs r JOIN $F_issues i ON i.query_id = r.query_id
    WHERE EXISTS (SELECT 1 FROM $F_contracts f WHERE f.project = i.project AND f.path = r.file AND f.export_sig <> '')""")
def _(t):
    usable = t("F_contracts").filter("export_sig <> ''").select("project", "path")
    return R.log_rule(t("F_issues"), usable).select("query_id", "file", "line")


_TARGET = f"""{_WORDS}, aim AS (SELECT i.query_id, i.project, p.file AS target, p.line,
      EXISTS (SELECT 1 FROM asked a WHERE a.query_id = i.query_id AND a.path = p.file) AS requested
      FROM $F_issues i JOIN placed p ON p.query_id = i.query_id AND place = 1),
    body AS (SELECT project, path, content, string_split(content, chr(10)) AS ls FROM $F_bodies),
    tsec AS (SELECT query_id, a.project, path, CASE WHEN requested THEN 'full' WHEN line BETWEEN 2 AND 4 OR line IS NOT NULL THEN 'slice'
        WHEN len(ls) <= 200 THEN 'full' ELSE 'signatures' END AS kind,
      CASE WHEN requested THEN 1 WHEN line BETWEEN 2 AND 4 THEN 2 WHEN line IS NOT NULL THEN greatest(1, least(line, len(ls)) - 5)
        WHEN len(ls) <= 200 THEN 1 END AS start_line,
      CASE WHEN requested THEN len(ls) WHEN line BETWEEN 2 AND 4 THEN 4 WHEN line IS NOT NULL THEN least(len(ls), least(line, len(ls)) + 5)
        WHEN len(ls) <= 200 THEN len(ls) END AS end_line, content, ls, requested FROM aim a JOIN body b ON b.project = a.project AND b.path = a.target)"""
_OUTLINE = """'export const speed' || chr(10) || 'imports: ./boot.js (start)'"""
_OUTLINED = "'export ' || regexp_extract(content, 'function \\w+\\(x, y\\)', 0) || chr(10) || " + _OUTLINE


@query("c4_target_section", f"""WITH {_TARGET}
    SELECT query_id, path, kind, start_line, end_line, CASE WHEN kind = 'signatures' THEN {_OUTLINED}
      ELSE array_to_string(list_slice(ls, start_line, end_line), chr(10)) END AS text FROM tsec""")
def _(t):
    issues, ranked = t("F_issues"), _ranked(t)
    aim = R.targets(issues, ranked).filter("target IS NOT NULL")
    asked = C.requested_files(issues).select("query_id", F.col("path").alias("target"), F.lit(True).alias("requested"))
    symbols = issues.select("query_id", T.called_symbol(F.concat("logs", "issue")).alias("symbol"))
    rows = aim.join(asked, ["query_id", "target"], "left").fillna({"requested": False}).join(symbols, "query_id")
    return C.target_sections(rows, t("F_bodies"), whole_lines=200).select("query_id", "path", "kind", "start_line", "end_line", "text")


@query("c5_outline", f"SELECT path, {_OUTLINED} AS outline FROM $F_bodies")
def _(t):
    return t("F_bodies").select("path", C.outline(F.col("path"), F.col("content")).alias("outline"))


@query("c6_dependents_section", f"""WITH RECURSIVE {_TARGET}, back AS (SELECT DISTINCT dst AS src, src AS dst FROM $F_kdeps),
    reach(seed, id) AS (SELECT DISTINCT CAST(project AS STRING) || '|' || target, CAST(project AS STRING) || '|' || target FROM aim
      UNION SELECT r.seed, l.dst FROM reach r JOIN back l ON l.src = r.id)
    SELECT a.query_id, a.project, a.target, substr(r.id, instr(r.id, '|') + 1) AS dependent
    FROM aim a JOIN reach r ON r.seed = CAST(a.project AS STRING) || '|' || a.target WHERE r.id <> r.seed""")
def _(t):
    aim = R.targets(t("F_issues"), _ranked(t)).filter("target IS NOT NULL")
    return C.dependents_rows(aim, t("F_nodes"), t("F_deps"))


_SECTIONS = f"""{_TARGET.replace("len(ls) <= 200", "true")}, parts AS (
      SELECT query_id, path, 'target' AS part, kind, length(CASE WHEN kind = 'signatures' THEN {_OUTLINED}
        ELSE array_to_string(list_slice(ls, start_line, end_line), chr(10)) END) AS chars, requested FROM tsec
      UNION ALL SELECT a.query_id, a.path, 'requested', 'full', length(b.content), true FROM asked a JOIN body b ON b.project = a.project AND b.path = a.path
        WHERE NOT EXISTS (SELECT 1 FROM aim m WHERE m.query_id = a.query_id AND m.target = a.path)
      UNION ALL SELECT p.query_id, p.file, 'signatures', 'signatures', length({_OUTLINED}), false FROM placed p JOIN body b ON b.project = p.project AND b.path = p.file
        WHERE place BETWEEN 2 AND 6 AND NOT EXISTS (SELECT 1 FROM asked a WHERE a.query_id = p.query_id AND a.path = p.file)),
    packed AS (SELECT *, requested AND sum(chars) OVER (PARTITION BY query_id) - 600 > coalesce(sum(chars) OVER (
      PARTITION BY query_id, requested ORDER BY chars DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dropped FROM parts)"""


def _sections(t, ranked=None):
    return C.compile_sections(t("F_issues"), t("F_bodies"), t("F_contracts"), t("F_deps"), ranked, budget=600)


@query("c1_context_compilation", f"WITH {_SECTIONS} SELECT query_id, part, path, kind, chars, dropped FROM packed")
def _(t):
    return _sections(t).select("query_id", "part", "path", "kind", "chars", "dropped")


@query("c8_budget_packing", f"""WITH {_SECTIONS}
    SELECT query_id, sum(CASE WHEN dropped THEN 0 ELSE chars END) AS kept, count(*) FILTER (WHERE dropped) AS dropped FROM packed GROUP BY query_id""")
def _(t):
    return _sections(t).groupBy("query_id").agg(
        F.sum(F.when(F.col("dropped"), 0).otherwise(F.col("chars"))).alias("kept"), F.count_if("dropped").alias("dropped"))


@query("c9_gap_report", f"""WITH {_SECTIONS}
    SELECT query_id, file, arg_min(reason, r) AS reason FROM (
      SELECT a.query_id, a.path AS file, CASE WHEN b.path IS NULL THEN 'missing' WHEN length(b.content) > 400 THEN 'oversize' END AS reason, 0 AS r
        FROM asked a LEFT JOIN body b ON b.project = a.project AND b.path = a.path
      UNION ALL SELECT r.query_id, r.file, 'missing', 1 FROM refs r JOIN $F_issues i ON i.query_id = r.query_id
        WHERE NOT EXISTS (SELECT 1 FROM body b WHERE b.project = i.project AND b.path = r.file)
      UNION ALL SELECT query_id, path, 'dropped', 2 FROM packed WHERE dropped) u WHERE reason IS NOT NULL GROUP BY query_id, file""")
def _(t):
    return C.gaps(t("F_issues"), t("F_bodies"), _sections(t), limit=400)


@query("c10_prompt_size", f"""WITH {_SECTIONS},
    whole AS (SELECT p.query_id, sum(length(b.content)) AS n FROM placed p JOIN body b ON b.project = p.project AND b.path = p.file WHERE place <= 6 GROUP BY p.query_id),
    kept AS (SELECT query_id, sum(CASE WHEN dropped THEN 0 ELSE chars END) AS chars FROM packed GROUP BY query_id)
    SELECT k.query_id, chars, CAST(floor(chars / 4.0 + 0.5) AS BIGINT) AS tokens, coalesce(n, 0) AS full_chars,
      CASE WHEN coalesce(n, 0) > 0 THEN greatest(0, CAST(floor((n - chars) * 100.0 / n + 0.5) AS BIGINT)) ELSE 0 END AS saving
    FROM kept k LEFT JOIN whole w ON w.query_id = k.query_id""")
def _(t):
    ranked = cut(R.top_ranked(_ranked(t)).select("query_id", "project", "file", "score", "line"))
    return C.totals(_sections(t, ranked), ranked, t("F_bodies"))


@query("c11_brief_counts", """
    WITH n AS (SELECT project, count(*) AS nodes FROM $F_sources GROUP BY project), e AS (SELECT project, count(*) AS edges FROM $F_deps GROUP BY project),
    i AS (SELECT user_id AS project, count(*) AS instances FROM $events GROUP BY user_id)
    SELECT p.project, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, 0 AS prefabs, coalesce(instances, 0) AS instances
    FROM (SELECT project FROM n UNION SELECT project FROM e UNION SELECT project FROM i) p
    LEFT JOIN n ON n.project = p.project LEFT JOIN e ON e.project = p.project LEFT JOIN i ON i.project = p.project""")
def _(t):
    nodes = t("F_sources").select("project", F.col("path").alias("id"))
    return C.brief_counts(nodes, t("F_deps"), t.table("events").select(F.col("user_id").alias("project")))
