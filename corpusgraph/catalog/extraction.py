"""Extraction from source text, declarations, resolution and extracted graphs."""

from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.catalog.fixtures import query
from corpusgraph.catalog.paths import _FOLD, _TARGET, quoted
from corpusgraph.functions import code, markup, sections
from corpusgraph.functions import paths as P
from corpusgraph.functions import slots as S
from corpusgraph.functions import text as T
from corpusgraph.functions.exprs import joined
from corpusgraph.operators import extraction as X
from corpusgraph.operators import resolve as R
from corpusgraph.operators import spans
from corpusgraph.plans.loops import by_shuffle
from corpusgraph.sources import declared


def one_project(frame):
    return frame.withColumn("project", F.lit(0))


def _code(t):
    return one_project(t("F_code"))


@query("x1_page_links", """
    SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1)) AS link FROM $pages""")
def _(t):
    return t.table("pages").select("page_id", F.explode(markup.tag_attribute(F.col("html"), "a", "href")).alias("link"))


@query("x1_script_sources", """
    SELECT page_id, link FROM (
      SELECT page_id, 'js/a' || CAST(page_id % 5 AS STRING) || '.js' AS link FROM $pages
      UNION ALL SELECT page_id, '/lib/b.js' FROM $pages UNION ALL SELECT page_id, 'c.js' FROM $pages) u""")
def _(t):
    number = (F.col("page_id") % 5).cast("string")
    html = F.concat(F.lit('<!-- <script src="no.js"> --><script type="module" SRC = "js/a'), number,
                    F.lit('.js"></script><script data-src="x.js" src=\'/lib/b.js\'></script>'),
                    F.regexp_replace("html", "<(/?)script", "<$1noscript"), F.lit("<script src=c.js async>"))
    return t.table("pages").select("page_id", F.explode(markup.tag_attribute(html, "script", "src")).alias("link"))


@query("s5_page_entry_points", f"""
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1)) AS href FROM $pages),
    r AS (SELECT page_id, substr({_FOLD.format(path="href")}, 2) AS target FROM l
      WHERE href LIKE '/%' AND href NOT LIKE '//%'),
    known AS (SELECT DISTINCT regexp_extract(html, '<a href="/([^"]*)"', 1) AS path FROM $pages)
    SELECT page_id, string_agg(DISTINCT target, ',' ORDER BY target) AS scripts FROM r
    WHERE target IN (SELECT path FROM known) AND target <> '' GROUP BY page_id""")
def _(t):
    table = t.table("pages")
    known = table.select(F.lit(0).alias("project"), F.regexp_extract("html", '<a href="/([^"]*)"', 1).alias("path")).distinct()
    pages = table.select(F.lit(0).alias("project"), F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("path"),
                         F.col("html").alias("content"))
    links = X.page_scripts(pages, known.filter("path <> ''"), "a", "href")
    return links.groupBy(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id")).agg(
        joined(F.array_sort(F.collect_set("script"))).alias("scripts"))


@query("x9_slot_hints", """
    SELECT asset_id, regexp_extract(hint, '@slot ([^:]+):', 1) AS asset, 'glb' AS format, 'walk,idle' AS animations FROM $F_assets""")
def _(t):
    rows = t("F_assets").select("asset_id", F.explode(S.hints(F.col("hint"))).alias("h"))
    return rows.select("asset_id", "h.asset", "h.slot.format", joined(F.col("h.slot.animations")).alias("animations"))


@query("x10_section_table", """
    SELECT file_id, section_no, line, kind, keys FROM (
      SELECT file_id, line, regexp_extract(s, '^\\[\\s*([a-z_]+)', 1) AS kind,
        row_number() OVER (PARTITION BY file_id ORDER BY line) AS section_no,
        array_to_string(regexp_extract_all(s, '([a-z_]+)=', 1), ',') AS keys
      FROM (SELECT file_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS s FROM (
        SELECT file_id, string_split(content, chr(10)) AS ls FROM $F_ini) a) b WHERE s LIKE '[%') c""")
def _(t):
    rows = t("F_ini").select("file_id", F.posexplode(sections.sections(F.col("content"))).alias("i", "s"))
    keys = F.transform("s.attributes", lambda a: a["key"])
    return rows.select("file_id", (F.col("i") + 1).alias("section_no"), "s.line", "s.kind", joined(keys).alias("keys"))


@query("x11_section_errors", """
    SELECT file_id, CASE WHEN content LIKE '[gd_scene%' THEN 9 ELSE 8 END AS line,
      'connection requires "signal", "from" and "to"' AS message FROM $F_ini WHERE file_id % 9 = 0
    UNION ALL SELECT file_id, 1, 'Missing [gd_scene] header — not a valid .tscn file' FROM $F_ini
    WHERE content NOT LIKE '[gd_scene%'""")
def _(t):
    parsed = sections.sections(F.col("content"))
    return t("F_ini").select("file_id", F.inline(sections.section_errors(parsed)))


@query("x12_root_script_id", "SELECT file_id, '2_s' AS root_script FROM $F_ini")
def _(t):
    return t("F_ini").select("file_id", sections.root_script_id(sections.sections(F.col("content"))).alias("root_script"))


@query("w8_section_carry_forward", """
    SELECT file_id, line, text, header FROM (
      SELECT file_id, line, text, last_value(CASE WHEN text LIKE '[%' THEN text END IGNORE NULLS) OVER (
        PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header
      FROM (SELECT file_id, generate_subscripts(ls, 1) AS line, trim(unnest(ls)) AS text FROM (
        SELECT file_id, string_split(content, chr(10)) AS ls FROM $F_settings) a) b) c""")
def _(t):
    return t("F_settings").select("file_id", F.inline(sections.lines_with_header(F.col("content")))).select(
        "file_id", "line", "text", "header")


@query("s14_autoloads", """
    SELECT project, 'Game' AS name, 'core/game' || CAST(s_nationkey AS STRING) || '.gd' AS target
    FROM (SELECT s_suppkey AS project, s_nationkey FROM $supplier) s
    UNION ALL SELECT s_suppkey, 'Bus', 'core/bus.gd' FROM $supplier""")
def _(t):
    return declared.autoload_rows(t("F_settings").withColumnRenamed("file_id", "project"))


@query("x13_module_imports", """
    SELECT path, regexp_extract(content, '(?m)^import \\{ \\w+ \\} from "([^"]+)"', 1) AS specifier,
      regexp_extract(content, '(?m)^import \\{ (\\w+) \\}', 1) AS names, false AS dynamic FROM $F_code""")
def _(t):
    return X.module_imports(_code(t)).select("path", "specifier", joined(F.col("names")).alias("names"), "dynamic")


@query("x14_module_exports", """
    SELECT path, 'function' AS kind, regexp_extract(content, 'export function (\\w+)', 1) AS name, 'x, y' AS parameters FROM $F_code
    UNION ALL SELECT path, 'const', regexp_extract(content, 'export const (\\w+)', 1), NULL FROM $F_code""")
def _(t):
    return X.module_exports(_code(t)).select("path", "kind", "name", "parameters")


@query("x15_asset_literals", """
    SELECT path, regexp_extract(content, '"(models/[^"]+)"', 1) AS asset FROM $F_code""")
def _(t):
    return t("F_code").select("path", F.explode(code.asset_literals(F.col("content"))).alias("asset"))


_TOKEN = """//[^\\n]*|/\\*(?s:.*?)\\*/|"(?:[^"\\\\]|\\\\.)*"|''(?:[^''\\\\]|\\\\.)*''|`(?:[^`\\\\]|\\\\.)*`|[^/"''`]+|/"""


@query("x16_blanked_source", f"""
    SELECT path, array_to_string(list_transform(regexp_extract_all(content, '{_TOKEN}', 0), lambda k:
      CASE WHEN k LIKE '//%' THEN '' WHEN k LIKE '"%' THEN '""' ELSE k END), '') AS blanked FROM $F_code""")
def _(t):
    return t("F_code").select("path", code.blank(F.col("content")).alias("blanked"))


@query("x17_script_contract", """
    SELECT path, 'MAX_' || n || ': Variant' AS const_part, 'died(reason, by),woke()' AS signals,
      'const MAX_' || n || ': Variant,enum Mode,run(delta: float) -> void,speed: float,stop() -> void' AS exports
    FROM (SELECT path, regexp_extract(content, 'MAX_(\\d+)', 1) AS n FROM $F_scripts WHERE content NOT LIKE '%broken%') s
    UNION ALL
    SELECT path, 'MAX_' || n || ': Variant', 'died(reason, by),woke()',
      'broken() -> void,const MAX_' || n || ': Variant,enum Mode,run(delta: float) -> void,speed: float,stop() -> void'
    FROM (SELECT path, regexp_extract(content, 'MAX_(\\d+)', 1) AS n FROM $F_scripts WHERE content LIKE '%broken%') s""")
def _(t):
    read = X.script_contracts(one_project(t("F_scripts")))
    const = F.regexp_replace(F.element_at(F.filter("exports", lambda e: e.startswith("const")), 1), "^const ", "")
    return read.select("path", const.alias("const_part"), joined(F.col("signals")).alias("signals"),
                       joined(F.col("exports")).alias("exports"))


@query("x18_identifiers", """
    SELECT DISTINCT path, name FROM (SELECT path, unnest(regexp_extract_all(content, '\\b([A-Za-z_]\\w*)\\b', 1)) AS name
      FROM $F_scripts) u WHERE name NOT IN (""" + quoted(code.SCRIPT_WORDS) + ")")
def _(t):
    return X.script_identifiers(one_project(t("F_scripts"))).select("path", "name")


@query("x19_function_spans", """
    SELECT path, regexp_extract(content, 'export function (\\w+)', 1) AS name, 3 AS start_line, 5 AS end_line, 0 AS depth FROM $F_code
    UNION ALL SELECT path, 'run', 8, 9, 0 FROM $F_scripts UNION ALL SELECT path, '_ready', 10, 11, 0 FROM $F_scripts
    UNION ALL SELECT path, 'broken', 12, 12, 0 FROM $F_scripts WHERE content LIKE '%broken%'
    UNION ALL SELECT path, 'stop', CASE WHEN content LIKE '%broken%' THEN 13 ELSE 12 END,
      CASE WHEN content LIKE '%broken%' THEN 14 ELSE 13 END, 0 FROM $F_scripts""")
def _(t):
    both = t("F_code").select("path", "content").unionByName(t("F_scripts").select("path", "content"))
    return spans.function_spans(one_project(both)).select("path", "name", "start_line", "end_line", "depth")


@query("x20_bodyless_functions", "SELECT path, 12 AS line FROM $F_scripts WHERE content LIKE '%broken%'")
def _(t):
    return t("F_scripts").select("path", F.explode(code.bodyless_functions(F.col("content"))).alias("line"))


@query("w9_function_at_line", """
    SELECT path, line, name, 3 AS start_line, 5 AS end_line FROM (
      SELECT path, file_id % 7 + 1 AS line, regexp_extract(content, 'export function (\\w+)', 1) AS name FROM $F_code) f
    WHERE line BETWEEN 3 AND 5""")
def _(t):
    files = _code(t)
    wanted = files.select("project", "path", (F.col("file_id") % 7 + 1).alias("line"))
    return spans.function_at_line(spans.function_spans(files), wanted).drop("project")


@query("w10_function_by_name", """
    SELECT path, regexp_extract(content, 'export function (\\w+)', 1) AS name, 3 AS start_line, 5 AS end_line FROM $F_code""")
def _(t):
    return spans.function_by_name(spans.function_spans(_code(t))).drop("project")


@query("v11_source_lint", """
    SELECT path, 4 AS line, 10 AS "column", 'no-math-random' AS rule, 'Math.random' AS text FROM $F_code
    UNION ALL SELECT path, 6, 1, 'no-module-mutable-state', string_split(content, chr(10))[6] FROM $F_code
    UNION ALL SELECT path, 7, instr(s, 'window'), 'no-dom-global', 'window' FROM (
      SELECT path, string_split(content, chr(10))[7] AS s FROM $F_code) l""")
def _(t):
    return t("F_code").select("path", F.inline(code.lint(F.col("content"))))


@query("v12_forbidden_globals", """
    SELECT path, 'window' AS name, min(line) AS line FROM (
      SELECT path, generate_subscripts(ls, 1) AS line, unnest(ls) AS s FROM (
        SELECT path, string_split(content, chr(10)) AS ls FROM $F_code) a) b
    WHERE regexp_matches(s, '\\bwindow\\b') GROUP BY path""")
def _(t):
    return t("F_code").select("path", F.inline(code.first_global_lines(F.col("content"))))


@query("p25_signature_format", """
    SELECT path, 'const ' || regexp_extract(content, 'export const (\\w+)', 1) || ','
      || 'function ' || regexp_extract(content, 'export function (\\w+)', 1) || '(x, y)' AS signatures FROM $F_code""")
def _(t):
    return t("F_code").select("path", joined(code.export_signatures(F.col("content"))).alias("signatures"))


_SLOT = """SELECT asset_id, path,
    CASE WHEN companion_json IS NOT NULL THEN json_extract_string(companion_json, '$.slot')
      ELSE regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.(glb|ogg)$', '') END AS slot,
    lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS format,
    CASE WHEN companion_json IS NOT NULL THEN 'idle,run' END AS animations,
    CAST(json_extract_string(companion_json, '$.rigged') AS BOOLEAN) AS rigged,
    CASE WHEN companion_json IS NOT NULL THEN 2500 END AS max_size_kb FROM $F_assets"""


@query("p27_slot_normalise", f"SELECT asset_id, slot, format, animations, rigged, max_size_kb FROM ({_SLOT}) s")
def _(t):
    raw = S.raw_slot(F.coalesce("companion_json", F.lit("{}")))
    slot = t("F_assets").select("asset_id", S.normalize(raw, F.col("path")).alias("s"))
    return slot.select("asset_id", "s.slot", "s.format", joined(F.col("s.animations")).alias("animations"),
                       "s.rigged", "s.max_size_kb")


@query("p26_slot_capabilities", f"""
    SELECT asset_id, CASE WHEN animations IS NULL THEN 'format: ' || format ELSE 'animation: idle,animation: run,format: '
      || format || ',max_size_kb: 2500,rigged: ' || CAST(rigged AS STRING) END AS capabilities FROM ({_SLOT}) s""")
def _(t):
    raw = S.raw_slot(F.coalesce("companion_json", F.lit("{}")))
    slot = S.normalize(raw, F.col("path"))
    return t("F_assets").select("asset_id", joined(S.capabilities(slot)).alias("capabilities"))


def _companion_files(t):
    name = F.when(F.col("asset_id") % 2 == 0, F.concat("path", F.lit(".slot.json"))).otherwise(
        F.regexp_replace("path", r"\.[^/.]+$", ".slot.json"))
    return t("F_assets").filter("companion_json IS NOT NULL").select(name.alias("path"), F.col("companion_json").alias("content"))


def _registry(t):
    path = F.col("path")
    key = F.when(F.col("asset_id") % 3 == 0, path).when(F.col("asset_id") % 3 == 1, S.slot_stem(path)).otherwise(
        F.substring_index(path, "/", -1))
    return t("F_assets").filter("registry_json IS NOT NULL").select(
        F.lit(0).alias("registry_rank"), key.alias("key"), F.col("registry_json").alias("value"))


@query("s11_companion_slots", "SELECT asset_id, companion_json AS companion FROM $F_assets")
def _(t):
    return declared.companion_slots(t("F_assets").select("asset_id", "path"), _companion_files(t)).select("asset_id", "companion")


@query("s12_registry_slots", "SELECT asset_id, registry_json AS registry FROM $F_assets")
def _(t):
    return declared.registry_slots(t("F_assets").select("asset_id", "path"), _registry(t)).select("asset_id", "registry")


def resolved_slots(t):
    """Every asset with the slot that its first declaration gives it."""
    assets = t("F_assets").select("asset_id", "path", "size_kb")
    found = declared.registry_slots(declared.companion_slots(assets, _companion_files(t)), _registry(t))
    hints = R.slot_hints(t("F_assets").select("path", F.col("hint").alias("content"))).select(
        F.col("asset").alias("path"), "hint").dropDuplicates(["path"])
    return R.resolve_slots(found.join(by_shuffle(hints), "path", "left"))


SLOTS_SQL = """SELECT asset_id, path, size_kb, source,
    CASE source WHEN 'companion' THEN json_extract_string(companion_json, '$.slot') WHEN 'registry' THEN 'reg' ELSE stem END AS slot,
    CASE source WHEN 'registry' THEN 'glb' WHEN 'hint' THEN 'glb' ELSE lower(regexp_extract(path, '\\.([^.]*)$', 1)) END AS format,
    CASE source WHEN 'companion' THEN 'idle,run' WHEN 'registry' THEN 'idle,walk' WHEN 'hint' THEN 'idle,walk' END AS animations,
    CASE WHEN source = 'companion' THEN CAST(json_extract_string(companion_json, '$.rigged') AS BOOLEAN) END AS rigged,
    CASE WHEN source = 'companion' THEN 2500 END AS max_size_kb
  FROM (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.(glb|ogg)$', '') AS stem,
      CASE WHEN companion_json IS NOT NULL THEN 'companion' WHEN registry_json IS NOT NULL THEN 'registry'
        WHEN path LIKE '%.ogg' THEN 'hint' ELSE 'default' END AS source FROM $F_assets) s"""


@query("j7_slot_precedence", f"SELECT asset_id, source, slot, format, animations, rigged, max_size_kb FROM ({SLOTS_SQL}) q")
def _(t):
    return resolved_slots(t).select("asset_id", "source", "slot.slot", "slot.format",
                                    joined(F.col("slot.animations")).alias("animations"), "slot.rigged", "slot.max_size_kb")


@query("s13_declared_dependencies", """
    SELECT project, CASE WHEN package_json LIKE '{bad%' THEN '' ELSE 'three,zod' END AS dependencies,
      CASE WHEN package_json LIKE '{bad%' THEN '' ELSE 'vitest' END AS dev_dependencies FROM $F_pkg""")
def _(t):
    text = F.col("package_json")
    return t("F_pkg").select("project", joined(declared.package_names(text, "dependencies")).alias("dependencies"),
                             joined(declared.package_names(text, "devDependencies")).alias("dev_dependencies"))


_RESOLVED = f"""SELECT project, path, specifier, target FROM (
    SELECT i.project, i.path, i.specifier, k.path AS target, row_number() OVER (
      PARTITION BY i.project, i.path, i.specifier ORDER BY c.pr) AS rn
    FROM (SELECT DISTINCT project, path, specifier, substr({_TARGET}, 2) AS base FROM $F_imports
      WHERE specifier LIKE '.%' OR specifier LIKE '/%') i
    JOIN (SELECT 0 AS pr, '.ts' AS ext, '.js' AS cut UNION ALL SELECT 1, '.ts', '' UNION ALL SELECT 2, '/index.ts', '') c
      ON (c.cut = '.js') = (i.base LIKE '%.js')
    JOIN (SELECT DISTINCT project, path FROM $F_imports) k
      ON k.project = i.project AND k.path = regexp_replace(i.base, '\\.js$', '') || c.ext) r WHERE rn = 1"""


def _resolved(t):
    imports = t("F_imports").select("project", "path", "specifier")
    return R.resolve_imports(imports, imports.select("project", "path").distinct())


@query("j1_specifier_resolution", f"SELECT * FROM ({_RESOLVED}) r")
def _(t):
    return _resolved(t).select("project", "path", "specifier", "target")


@query("j2_import_edges", f"""
    SELECT i.project, i.path AS src, r.target AS dst, 'import' AS kind FROM $F_imports i
    JOIN ({_RESOLVED}) r ON i.project = r.project AND i.path = r.path AND i.specifier = r.specifier""")
def _(t):
    return R.import_edges(_resolved(t))


def _assets(t):
    return t.sql("SELECT DISTINCT 0 AS project, 'models/' || p_name || '.glb' AS asset FROM $part WHERE p_brand = 'Brand#1'")


_EXISTING = "SELECT DISTINCT 'models/' || p_name || '.glb' AS asset FROM $part WHERE p_brand = 'Brand#1'"
_LITERAL = "SELECT path, regexp_extract(content, '\"(models/[^\"]+)\"', 1) AS asset FROM $F_code"


@query("j3_asset_edges", f"""
    SELECT path AS src, asset AS dst, 'asset_ref' AS kind FROM ({_LITERAL}) l WHERE asset IN ({_EXISTING})""")
def _(t):
    return R.asset_edges(X.module_assets(_code(t)), _assets(t)).drop("project")


@query("j4_missing_assets", f"""
    SELECT path, asset, path || ' references ' || asset || ', which does not exist' AS reason
    FROM ({_LITERAL}) l WHERE asset NOT IN ({_EXISTING})""")
def _(t):
    return R.missing_assets(X.module_assets(_code(t)), _assets(t)).drop("project")


def _by_file(frame):
    return frame.withColumnRenamed("file_id", "project")


@query("j5_autoload_requirements", """
    SELECT file_id AS project, path, 'Game' AS name, 'core/game' || CAST(s_nationkey AS STRING) || '.gd' AS target
    FROM $F_scripts f JOIN $supplier s ON s.s_suppkey = f.file_id WHERE regexp_matches(content, '\\bGame\\b')""")
def _(t):
    return R.autoload_requirements(X.script_identifiers(_by_file(t("F_scripts"))),
                                   declared.autoload_rows(_by_file(t("F_settings"))))


_EXT = """SELECT file_id AS project, path AS src, unnest(regexp_extract_all(content, 'path="res://([^"]+)"', 1)) AS dst FROM $F_ini"""


@query("j6_resource_edges", f"""
    SELECT project, src, dst, CASE WHEN dst LIKE '%.png' THEN 'asset_ref' ELSE 'ext_resource' END AS kind FROM ({_EXT}) e
    WHERE dst LIKE '%.png' OR dst = src OR dst = 'scripts/s' || CAST(project AS STRING) || '.gd'""")
def _(t):
    scenes, scripts = _by_file(t("F_ini")), _by_file(t("F_scripts"))
    known = scenes.select("project", "path").unionByName(scripts.select("project", "path"))
    return R.resource_edges(X.external_resources(scenes), known)


_SIGNALS = f"""SELECT DISTINCT project, src, dst, 'signal_connection' AS kind FROM ({_EXT}) e JOIN (
    SELECT file_id, regexp_extract(content, 'from="([^"]+)"', 1) AS source FROM $F_ini) c ON c.file_id = e.project
    WHERE dst LIKE '%.tscn' AND dst = src AND lower(regexp_extract(dst, '([^/]*)\\.tscn$', 1)) = lower(source)"""


@query("j8_signal_sources", f"SELECT * FROM ({_SIGNALS}) s")
def _(t):
    scenes = _by_file(t("F_ini"))
    return R.signal_edges(X.connections(scenes), X.external_resources(scenes), scenes.select("project", "path"))


@query("j9_signal_edge_dedupe", f"SELECT src, count(*) AS n FROM ({_SIGNALS}) s GROUP BY src")
def _(t):
    scenes = _by_file(t("F_ini"))
    doubled = X.connections(scenes).unionByName(X.connections(scenes))
    edges = R.signal_edges(doubled, X.external_resources(scenes), scenes.select("project", "path"))
    return edges.groupBy("src").agg(F.count("*").alias("n"))


@query("j10_contract_inheritance", """
    SELECT f.file_id AS project, f.path, CASE WHEN f.file_id % 3 = 0 THEN '' ELSE 'died(reason, by),woke()' END AS signals,
      CASE WHEN f.file_id % 3 = 0 THEN 0 WHEN f.file_id % 4 = 0 THEN 6 ELSE 5 END AS n_exports, 0 AS n_requires FROM $F_ini f""")
def _(t):
    scenes = _by_file(t("F_ini"))
    got = R.inherit_contracts(X.root_scripts(scenes), X.script_contracts(_by_file(t("F_scripts"))))
    return got.select("project", "path", joined(F.col("signals")).alias("signals"),
                      F.size("exports").alias("n_exports"), F.size("requires").alias("n_requires"))


@query("j13_import_policy", """
    WITH i AS (SELECT DISTINCT path, specifier FROM $F_imports)
    SELECT path, specifier, 'forbidden_package' AS rule FROM i WHERE specifier LIKE 'three/%'
    UNION ALL SELECT path, specifier, 'forbidden_name' FROM i WHERE specifier LIKE 'three/%'
    UNION ALL SELECT path, specifier, 'escapes_root' FROM i
    WHERE specifier LIKE '../%' AND regexp_extract(path, 'src/(m\\d+)/', 1) <> 'm3'
      AND regexp_extract(specifier, '\\.\\./(m\\d+)/', 1) <> 'm3'
    UNION ALL SELECT path, specifier, 'escapes_root' FROM i WHERE specifier LIKE './%' AND path NOT LIKE 'src/m3/%'
    UNION ALL SELECT path, specifier, 'escapes_root' FROM i WHERE specifier LIKE '../%' AND path LIKE 'src/m3/%'
      AND specifier NOT LIKE '../m3/%'""")
def _(t):
    distinct = t("F_imports").select("path", "specifier").distinct()
    return R.import_policy(distinct, ["three"], "src/m3/")


@query("j14_pinned_versions", """
    WITH p AS (SELECT project, regexp_extract(package_json, '"three":"([^"]*)"', 1) AS v,
      package_json LIKE '{bad%' AS bad FROM $F_pkg)
    SELECT project, CASE WHEN NOT bad THEN v END AS version,
      CASE WHEN bad THEN 'unreadable' WHEN regexp_matches(v, '[\\^~><=x*]|\\s-\\s') THEN 'range' END AS problem FROM p
    UNION ALL SELECT -1, CAST(count(DISTINCT v) AS STRING), CASE WHEN count(DISTINCT v) > 1 THEN 'inconsistent' END
    FROM p WHERE NOT bad AND NOT regexp_matches(v, '[\\^~><=x*]|\\s-\\s')""")
def _(t):
    pins = R.pinned_versions(t("F_pkg"), "three")
    verdict = R.version_consistency(pins).select(
        F.lit(-1).cast("long").alias("project"), F.col("versions").cast("string").alias("version"),
        F.when(~F.col("consistent"), "inconsistent").alias("problem"))
    return pins.unionByName(verdict)


@query("j15_created_or_overwritten", """
    SELECT reply_id, path, CASE WHEN path LIKE '%.js' AND path NOT LIKE '%..%' AND
      CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) % 2 = 0 THEN 'overwritten' ELSE 'created' END AS outcome
    FROM (SELECT reply_id, regexp_extract(reply, 'FILE: (\\S+)', 1) AS path FROM $F_replies) r""")
def _(t):
    from corpusgraph.operators import replies
    known = t.sql("SELECT DISTINCT 'src/' || CAST(conv_id % 20 * 2 AS STRING) || '.js' AS path FROM $conversations")
    return R.created_or_overwritten(replies.file_block_rows(t("F_replies")), known).select("reply_id", "path", "outcome")


@query("g1_module_graph", f"""
    SELECT 'edge' AS part, path AS a, 'src/p' || CAST(file_id % 97 AS STRING) || '.js' AS b, 'import' AS kind FROM $F_code
    UNION ALL SELECT 'edge', path, asset, 'asset_ref' FROM ({_LITERAL}) l WHERE asset IN ({_EXISTING})
    UNION ALL SELECT 'node', path, NULL, 'module' FROM $F_code
    UNION ALL SELECT DISTINCT 'node', asset, NULL, 'asset' FROM ({_LITERAL}) l WHERE asset IN ({_EXISTING})""")
def _(t):
    graph = X.module_graph(_code(t), _assets(t))
    edges = graph["edges"].select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind")
    nodes = graph["nodes"].select(F.lit("node").alias("part"), F.col("id").alias("a"),
                                  F.lit(None).cast("string").alias("b"), F.col("type").alias("kind"))
    return edges.unionByName(nodes)


_SOUND = "project % 9 <> 0 AND project % 10 <> 3"


@query("g2_scene_graph", f"""
    SELECT src, dst, CASE WHEN dst LIKE '%.png' THEN 'asset_ref' ELSE 'ext_resource' END AS kind FROM ({_EXT}) e
    WHERE {_SOUND} AND (dst LIKE '%.png' OR dst = src OR dst = 'scripts/s' || CAST(project AS STRING) || '.gd')
    UNION ALL SELECT src, dst, kind FROM ({_SIGNALS}) s WHERE {_SOUND}
    UNION ALL SELECT path, 'core/game' || CAST(s_nationkey AS STRING) || '.gd', 'requires'
    FROM $F_scripts f JOIN $supplier s ON s.s_suppkey = f.file_id""")
def _(t):
    return X.scene_graph(_by_file(t("F_ini")), _by_file(t("F_scripts")), _by_file(t("F_settings"))).drop("project")


@query("g3_single_file", f"""
    SELECT path, asset AS dst FROM ({_LITERAL}) l WHERE path = 'src/p7.js'
    UNION ALL SELECT path, 'scenes/S' || CASE WHEN file_id % 4 = 0 THEN CAST(file_id AS STRING) ELSE
      CAST((SELECT s_nationkey FROM $supplier WHERE s_suppkey = 7) AS STRING) END || '.tscn' FROM $F_ini WHERE file_id = 7
    UNION ALL SELECT path, 'scripts/s7.gd' FROM $F_ini WHERE file_id = 7
    UNION ALL SELECT path, 'art/' || CAST((SELECT s_nationkey FROM $supplier WHERE s_suppkey = 7) AS STRING) || '.png'
    FROM $F_ini WHERE file_id = 7""")
def _(t):
    module = X.single_module(_code(t), "src/p7.js", _assets(t)).select("path", "dst")
    return module.unionByName(X.single_scene(one_project(t("F_ini")), "scenes/S7.tscn").select("path", "dst"))


@query("f3_problem_rows", f"""
    SELECT 'missing_asset' AS problem, path, path || ' references ' || asset || ', which does not exist' AS reason
    FROM ({_LITERAL}) l WHERE asset NOT IN ({_EXISTING})
    UNION ALL SELECT 'unparseable', path, 'connection requires "signal", "from" and "to"' FROM $F_ini WHERE file_id % 9 = 0
    UNION ALL SELECT 'unparseable', path, 'Missing [gd_scene] header — not a valid .tscn file' FROM $F_ini
    WHERE content NOT LIKE '[gd_scene%'""")
def _(t):
    missing = X.module_graph(_code(t), _assets(t))["missing"].select(
        F.lit("missing_asset").alias("problem"), "path", "reason")
    bad = t("F_ini").select("path", F.inline(sections.section_errors(sections.sections(F.col("content")))))
    return missing.unionByName(bad.select(F.lit("unparseable").alias("problem"), "path", F.col("message").alias("reason")))
