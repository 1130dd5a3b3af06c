"""Issue, log, reply and signature expressions; search; slices."""

from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.catalog.fixtures import query
from corpusgraph.catalog.paths import quoted
from corpusgraph.functions import slices as S
from corpusgraph.functions import text as T
from corpusgraph.functions.exprs import joined
from corpusgraph.operators import replies, search

_STOP = quoted(K.STOP_WORDS)


@query("p13_issue_tokens", f"""
    SELECT query_id, array_to_string(list_filter(regexp_split_to_array(lower(issue), '[^a-z0-9_.-]+'),
      lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), ',') AS tokens FROM $F_issues""")
def _(t):
    return t("F_issues").select("query_id", joined(T.issue_tokens(F.col("issue"))).alias("tokens"))


@query("p14_described_symbols", f"""
    SELECT query_id, string_agg(DISTINCT w, ',' ORDER BY w) AS symbols FROM (
      SELECT query_id, unnest(list_transform(regexp_extract_all(issue, '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\b', 1),
        lambda w: lower(w))) AS w FROM $F_issues) u
    WHERE length(w) >= 3 AND w NOT IN ({_STOP}) GROUP BY query_id""")
def _(t):
    return t("F_issues").select(
        "query_id", joined(F.array_sort(T.described_symbols(F.col("issue")))).alias("symbols"))


@query("p15_binding_name", """
    SELECT path, nullif(regexp_extract(export_sig,
      '^\\s*(?:async\\s+)?(?:function\\s*\\*?\\s*|class\\s+|const\\s+|let\\s+|var\\s+)?([A-Za-z_$][A-Za-z0-9_$]*)', 1), '')
      AS binding FROM $F_contracts""")
def _(t):
    return t("F_contracts").select("path", T.binding_name(F.col("export_sig")).alias("binding"))


@query("p16_called_symbol", f"""
    SELECT query_id, coalesce(
      list_filter(regexp_extract_all(text, '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1),
        lambda n: lower(n) NOT IN ({quoted(K.IGNORED_SYMBOLS)}))[1],
      list_filter(regexp_extract_all(text, '\\b(?:function|method|func)\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1),
        lambda n: lower(n) NOT IN ({quoted(K.IGNORED_SYMBOLS)}))[1]) AS symbol
    FROM (SELECT query_id, logs || issue AS text FROM $F_issues) q""")
def _(t):
    both = F.concat("logs", "issue")
    return t("F_issues").select("query_id", T.called_symbol(both).alias("symbol"))


_LINES = "SELECT path, unnest(string_split(content, chr(10))) AS line FROM $F_files"


@query("p17_collapse_whitespace", f"""
    SELECT path, trim(regexp_replace(regexp_replace(line, '\\s*([(){{}}\\[\\];,:=<>+\\-*/])\\s*', '\\1', 'g'),
      '\\s+', ' ', 'g')) AS collapsed FROM ({_LINES}) l""")
def _(t):
    lines = t("F_files").select("path", F.explode(F.split("content", "\n", -1)).alias("line"))
    return lines.select("path", T.collapse_whitespace(F.col("line")).alias("collapsed"))


@query("p18_line_prefix_strip", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN find || chr(10) || 'second | line' ELSE pasted END AS stripped FROM (
      SELECT doc_id, find, '> 12 | ' || find || chr(10) || ' 13 | second | line' AS pasted FROM $F_edits) p
    WHERE doc_id % 2 = 0
    UNION ALL
    SELECT doc_id, 'x ' || find || chr(10) || ' 13 | second | line' FROM $F_edits WHERE doc_id % 2 = 1""")
def _(t):
    pasted = F.concat(F.when(F.col("doc_id") % 2 == 0, "> 12 | ").otherwise("x "), F.col("find"),
                      F.lit("\n 13 | second | line"))
    return t("F_edits").select("doc_id", T.strip_line_prefixes(pasted).alias("stripped"))


@query("p19_line_split", """
    SELECT path, len(string_split(content, chr(10))) AS search_lines,
      CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10)))
        - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS diff_lines FROM $F_files""")
def _(t):
    text = F.col("content")
    return t("F_files").select("path", F.size(T.search_lines(text)).alias("search_lines"),
                               F.size(T.diff_lines(text)).alias("diff_lines"))


_HITS = """SELECT path, line, greatest(instr(lower(bare), 'the'), 1) AS "column", bare AS text FROM (
        SELECT path, generate_subscripts(ls, 1) AS line, unnest(ls) AS raw, regexp_replace(unnest(ls), '^\\s+', '') AS bare
        FROM (SELECT path, string_split(content, chr(10)) AS ls FROM $F_files) a) b
      WHERE contains(lower(raw), 'the')"""


@query("p20_display_line", """SELECT path, line, "column", text FROM (
    """ + _HITS.replace("'the'", "'que'") + """) h""")
def _(t):
    return search.line_hits(t("F_files"), "QUE ")


@query("x21_line_search", _HITS)
def _(t):
    return search.line_hits(t("F_files"), " The ")


@query("x22_path_search", "SELECT path FROM $F_files WHERE contains(lower(path), 'src1/')")
def _(t):
    return search.name_hits(t("F_files"), "SRC1/")


@query("w7_capped_search", f"""
    WITH h AS ({_HITS})
    SELECT path, line, "column", text FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS rn FROM h) r
    WHERE rn <= 50 ORDER BY path, line LIMIT 500""")
def _(t):
    return search.capped_hits(t("F_files"), "the", K.SEARCH_LINES_PER_FILE, K.SEARCH_TOTAL_LINES)


@query("w7_search_all_kinds", f"""
    WITH h AS ({_HITS.replace("'the'", "'en/1'")}),
    n AS (SELECT path FROM $F_files WHERE contains(lower(path), 'en/1'))
    SELECT 'name' AS hit, path, NULL AS line, NULL AS "column", NULL AS text FROM n
    UNION ALL SELECT 'line', path, line, "column", text FROM h""")
def _(t):
    return search.search(t("F_files"), "en/1")


@query("a9_hits_by_path", f"""
    WITH h AS ({_HITS})
    SELECT path, count(*) AS n, string_agg(CAST(line AS STRING), ',' ORDER BY line) AS lines FROM h GROUP BY path""")
def _(t):
    return search.lines_by_path(search.line_hits(t("F_files"), "the"))


@query("a9_listed_paths", f"""
    WITH h AS ({_HITS}),
    n AS (SELECT path FROM $F_files WHERE contains(lower(path), 'src1'))
    SELECT path, row_number() OVER (ORDER BY part, path) AS position FROM (
      SELECT path, min(part) AS part FROM (SELECT path, 0 AS part FROM h UNION ALL SELECT path, 1 FROM n) u
      GROUP BY path) g""")
def _(t):
    files = t("F_files")
    return search.listed_paths(search.line_hits(files, "the"), search.name_hits(files, "src1"))


@query("a10_search_summary", """
    WITH per AS (SELECT path, size, len(list_filter(string_split(content, chr(10)), lambda s: contains(lower(s), 'the')))
      AS lines FROM $F_files)
    SELECT count(*) AS scanned, least(count(*) FILTER (WHERE contains(lower(path), 'the')), 200) AS name_hits,
      least(sum(least(lines, 50)), 500) AS line_hits, 0 AS skipped, count(*) FILTER (WHERE lines > 50) AS files_cut,
      count(*) FILTER (WHERE contains(lower(path), 'the')) > 200 AS names_cut,
      sum(least(lines, 50)) > 500 AS lines_cut FROM per""")
def _(t):
    return search.summary(t("F_files"), "the", K.SEARCH_LINES_PER_FILE, K.SEARCH_TOTAL_LINES, K.SEARCH_TOTAL_NAMES)


@query("p22_token_estimate", """
    SELECT path, CAST(floor(chars / 4.0 + 0.5) AS BIGINT) AS tokens,
      CASE WHEN size > 0 THEN greatest(0, CAST(floor((size * 2 - chars) * 100.0 / (size * 2) + 0.5) AS BIGINT)) ELSE 0 END
        AS saving FROM (SELECT path, length(content) AS chars, size FROM $F_files) f""")
def _(t):
    chars = F.length("content")
    return t("F_files").select("path", T.token_estimate(chars).alias("tokens"),
                               T.saving_percent(chars, F.col("size") * 2).alias("saving"))


@query("p24_signature_normalise", """
    SELECT path, trim(regexp_replace(export_sig, '\\s+', ' ', 'g')) AS signature FROM $F_contracts""")
def _(t):
    return t("F_contracts").select("path", T.normalize_signature(F.col("export_sig")).alias("signature"))


_REFS = """SELECT query_id, generate_subscripts(hits, 1) AS i, unnest(hits) AS h FROM (
      SELECT query_id, regexp_extract_all(regexp_replace(logs, 'res://', '', 'g'), '[A-Za-z0-9_./\\\\-]+(?::\\d+)?', 0) AS hits
      FROM {table}) r"""
REFERENCES = """SELECT query_id, file, line, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS ord FROM (
      SELECT query_id, file, line, min(i) AS i FROM (
        SELECT query_id, i, regexp_replace(h, ':\\d+$', '') AS file,
          CAST(nullif(regexp_extract(h, ':(\\d+)$', 1), '') AS BIGINT) AS line FROM (""" + _REFS + """) a) b
      WHERE file LIKE '%.%' AND lower(regexp_extract(file, '([^.]*)$', 1)) IN (""" + quoted(K.SOURCE_EXTENSIONS) + """)
      GROUP BY query_id, file, line) c"""


@query("x2_log_references", REFERENCES.replace("{table}", "$F_logs"))
def _(t):
    refs = t("F_logs").select("query_id", F.explode(T.file_references(F.col("logs"))).alias("r"))
    return refs.select("query_id", "r.file", "r.line", "r.ord")


@query("x3_attachment_requests", """
    SELECT reply_id, f AS file FROM (SELECT DISTINCT reply_id, f FROM (
      SELECT reply_id, unnest(regexp_extract_all(reply, '(?i)\\bNEED:\\s*([^\\s—\\n]+)', 1)) AS f FROM $F_replies) u) d""")
def _(t):
    return t("F_replies").select("reply_id", F.explode(T.attachment_requests(F.col("reply"))).alias("file"))


_ITEMS = """SELECT DISTINCT reply_id, item FROM (
      SELECT reply_id, regexp_replace(regexp_replace(raw, '^[\\s"''`*\\[\\]()]+', ''), '[\\s"''`*.,:\\[\\]()]+$', '') AS item
      FROM (SELECT reply_id, unnest(regexp_split_to_array(payload, '[,;\\n]+')) AS raw FROM (
        SELECT reply_id, unnest(regexp_extract_all(reply, '(?im)^[ \\t>*_-]*(?:context insufficient|need)[ \\t]*:(.+)$', 1)) AS payload
        FROM $F_replies) a) b) c WHERE item <> ''"""


@query("x4_context_requests", f"SELECT reply_id, item FROM ({_ITEMS}) i")
def _(t):
    return t("F_replies").select("reply_id", F.explode(T.context_requests(F.col("reply"))).alias("item"))


@query("x5_path_likeness", """
    SELECT doc_id, raw_path <> '' AND NOT regexp_matches(raw_path, '\\s') AND regexp_matches(raw_path, '^.+\\.[A-Za-z0-9]+$')
      AND (lower(regexp_extract(raw_path, '([^.]*)$', 1)) IN (""" + quoted(K.SOURCE_EXTENSIONS) + """)
        OR raw_path LIKE '%/%') AS path_like FROM $F_paths""")
def _(t):
    return t("F_paths").select("doc_id", T.looks_like_path(F.col("raw_path")).alias("path_like"))


@query("x6_clean_logs", """
    SELECT query_id, trim(array_to_string(list_filter(string_split(logs, chr(10)),
      lambda s: NOT regexp_matches(trim(s), '(?i)^NEED:\\s*([^\\s—\\n]+)')), chr(10))) AS logs FROM $F_issues""")
def _(t):
    return t("F_issues").select("query_id", T.clean_logs(F.col("logs")).alias("logs"))


@query("j11_missing_requests", f"""
    WITH items AS ({_ITEMS}), files AS (SELECT DISTINCT 'src/' || CAST(conv_id % 40 AS STRING) || '.js' AS path FROM $conversations)
    SELECT reply_id, item FROM items
    WHERE regexp_matches(item, '^\\S+\\.[A-Za-z0-9]+$') AND item NOT IN (SELECT path FROM files)""")
def _(t):
    known = t.sql("SELECT DISTINCT 'src/' || CAST(conv_id % 40 AS STRING) || '.js' AS path FROM $conversations")
    return replies.missing_requests(t("F_replies"), known)


@query("u1_distinct_references", f"""
    WITH a AS ({REFERENCES.replace("{table}", "$F_issues")}),
    b AS (SELECT query_id, f AS file FROM (SELECT query_id,
      unnest(regexp_extract_all(logs, '(?i)\\bNEED:\\s*([^\\s—\\n]+)', 1)) AS f FROM $F_issues) u)
    SELECT query_id, file, min(seq) AS seq FROM (
      SELECT query_id, file, ord AS seq FROM a UNION ALL SELECT query_id, file, 1000000 FROM b) u GROUP BY query_id, file""")
def _(t):
    return replies.requested_files(t("F_issues"))


@query("c2_line_window", """
    SELECT path, start_line, end_line, array_to_string(list_slice(ls, start_line, end_line), chr(10)) AS text FROM (
      SELECT path, ls, greatest(1, mid - 5) AS start_line, least(len(ls), mid + 5) AS end_line FROM (
        SELECT path, ls, least(greatest(size % 40, 1), len(ls)) AS mid FROM (
          SELECT path, size, string_split(content, chr(10)) AS ls FROM $F_files) a) b) c""")
def _(t):
    cut = t("F_files").select("path", S.around_line(F.col("content"), F.col("size") % 40).alias("s"))
    return cut.select("path", "s.start_line", "s.end_line", "s.text")


@query("c3_line_range", """
    SELECT path, array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) AS text FROM $F_files""")
def _(t):
    return t("F_files").select("path", S.line_range(F.col("content"), F.lit(2), F.lit(4)).alias("text"))


@query("c7_size_gate", """
    SELECT path, CASE WHEN size > 5000 THEN 'oversize' ELSE 'attach' END AS verdict,
      CASE WHEN size <= 5000 THEN md5(content) END AS digest FROM $F_files""")
def _(t):
    from corpusgraph.operators import context
    gated = context.size_gate(t("F_files"), limit=5000)
    return gated.select("path", "verdict", F.md5("content").alias("digest"))


@query("s15_brief_stats", """
    SELECT brief_id, mode, nodes, edges, prefabs, instances FROM (
      SELECT brief_id, CASE WHEN markdown LIKE '%mode=interactive -->%' THEN 'interactive' ELSE 'oneShot' END AS mode,
        CAST(nullif(regexp_extract(markdown, '(?m)^- Graph: (\\d+) node\\(s\\), \\d+ edge\\(s\\)$', 1), '') AS BIGINT) AS nodes,
        CAST(nullif(regexp_extract(markdown, '(?m)^- Graph: \\d+ node\\(s\\), (\\d+) edge\\(s\\)$', 1), '') AS BIGINT) AS edges,
        CAST(nullif(regexp_extract(markdown, '(?m)^- Prefab modules: (\\d+)$', 1), '') AS BIGINT) AS prefabs,
        CAST(nullif(regexp_extract(markdown, '(?m)^- Scene instances: (\\d+)$', 1), '') AS BIGINT) AS instances
      FROM $F_brief) b WHERE nodes IS NOT NULL AND edges IS NOT NULL AND prefabs IS NOT NULL AND instances IS NOT NULL
    UNION ALL
    SELECT brief_id, CASE WHEN markdown LIKE '%mode=interactive -->%' THEN 'interactive' ELSE 'oneShot' END,
      NULL, NULL, NULL, NULL FROM $F_brief WHERE NOT regexp_matches(markdown, '(?m)^- Prefab modules: \\d+$')""")
def _(t):
    stats = T.brief_stats(F.col("markdown"))
    read = t("F_brief").select("brief_id", T.brief_mode(F.col("markdown")).alias("mode"), stats.alias("s"))
    return read.select("brief_id", "mode", "s.nodes", "s.edges", "s.prefabs", "s.instances")


_FILE = r"(?i)(?:^|\n)[ \t]*(?:\*\*)?(?:#{1,6}[ \t]*)?(?:\*\*)?FILE:[ \t]*([^\r\n*`\"'']+)[`*\"'']*(?:\*\*)?[ \t]*\r?\n[ \t]*```[^\r\n]*\r?\n([\s\S]*?)\r?\n[ \t]*```"


@query("x7_file_blocks", f"""
    SELECT reply_id, generate_subscripts(p, 1) AS block_no, trim(unnest(p)) AS path, unnest(c) AS content FROM (
      SELECT reply_id, regexp_extract_all(reply, '{_FILE}', 1) AS p, regexp_extract_all(reply, '{_FILE}', 2) AS c
      FROM $F_replies) r""")
def _(t):
    return replies.file_block_rows(t("F_replies"))


@query("x8_edit_blocks", """
    SELECT doc_id AS reply_id, 1 AS block_no, path, find, replace FROM $F_edits
    WHERE path IS NOT NULL""")
def _(t):
    return replies.edit_block_rows(t("F_edit_replies"))
