"""Scan predicates and path expressions."""

from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.catalog.fixtures import Inputs, query
from corpusgraph.functions import paths as P
from corpusgraph.functions.exprs import joined
from corpusgraph.operators import summary
from corpusgraph.sources import files


def quoted(values):
    return ", ".join(f"'{v}'" for v in values)


_EXT = r"regexp_extract(lower(raw_path), '[^/](\.[^./]+)$', 1)"
_BASE = "regexp_extract(raw_path, '([^/]*)$', 1)"
_DIRS = "list_slice(string_split(raw_path, '/'), 1, len(string_split(raw_path, '/')) - 1)"
_SEGS = "string_split(replace(raw_path, chr(92), '/'), '/')"


@query("s1_corpus_scan", f"""
    SELECT project, replace(raw_path, chr(92), '/') AS path, {_EXT} AS extension FROM $F_paths
    WHERE NOT list_has_any({_DIRS}, [{quoted(K.IGNORED_DIRECTORIES)}])
      AND NOT regexp_matches(raw_path, '(^|/)\\.')
      AND NOT regexp_matches({_BASE}, '{K.VENDOR_SUFFIX}')
      AND {_EXT} IN ({quoted(K.MODULE_EXTENSIONS)})""")
def _(t: Inputs):
    table = t("F_paths").withColumnRenamed("raw_path", "path")
    return files.scan(table, K.MODULE_EXTENSIONS).select("project", "path", "extension")


@query("s2_ignored_directories", f"""
    SELECT doc_id, raw_path FROM $F_paths
    WHERE NOT list_has_any({_DIRS}, [{quoted(K.IGNORED_DIRECTORIES)}])""")
def _(t):
    return t("F_paths").filter(~P.in_ignored_directory(F.col("raw_path"))).select("doc_id", "raw_path")


@query("s3_vendor_exclusion", f"""
    SELECT doc_id, raw_path FROM $F_paths WHERE NOT regexp_matches({_BASE}, '{K.VENDOR_SUFFIX}')""")
def _(t):
    return t("F_paths").filter(~P.is_vendor_file(F.col("raw_path"))).select("doc_id", "raw_path")


@query("s4_depth_cap", """
    SELECT doc_id, len(string_split(raw_path, '/')) - 1 AS depth FROM $F_paths
    WHERE len(string_split(raw_path, '/')) - 1 <= 1""")
def _(t):
    depth = P.depth(F.col("raw_path"))
    return t("F_paths").filter(depth <= 1).select("doc_id", depth.alias("depth"))


@query("s6_scene_discovery", """
    SELECT project, scene_path FROM (
      SELECT project, path AS scene_path, row_number() OVER (PARTITION BY project
        ORDER BY CASE WHEN path = 'scene.json' THEN 0 ELSE 1 END, path) AS rn
      FROM (SELECT project, regexp_replace(raw_path, '^res://', '') AS path FROM $F_paths) p
      WHERE path = 'scene.json' OR (path LIKE 'scenes/%' AND path LIKE '%.scene.json')) r
    WHERE rn = 1""")
def _(t):
    table = t("F_paths").select("project", P.strip_resource_scheme(F.col("raw_path")).alias("path"))
    return files.discover_scenes(table)


@query("p1_extension_filter", f"""
    SELECT doc_id, {_EXT} AS extension FROM $F_paths WHERE {_EXT} IN ({quoted(K.SEARCH_EXTENSIONS)})""")
def _(t):
    path = F.col("raw_path")
    return t("F_paths").filter(P.has_extension(path, K.SEARCH_EXTENSIONS)).select(
        "doc_id", P.extension(path).alias("extension"))


@query("p2_asset_predicate", f"""
    SELECT doc_id FROM $F_paths WHERE {_EXT} IN ({quoted(K.ASSET_EXTENSIONS)})""")
def _(t):
    return t("F_paths").filter(P.is_asset(F.col("raw_path"))).select("doc_id")


@query("p3_asset_literal", f"""
    SELECT doc_id, literal FROM (
      SELECT doc_id, raw_path || CASE WHEN doc_id % 2 = 0 THEN '?v=1.2' ELSE '#top' END AS literal FROM $F_paths) l
    WHERE regexp_extract(lower(regexp_extract(literal, '^[^?#]*', 0)), '^.+(\\.[^.]*)$', 1)
      IN ({quoted(K.ASSET_LITERAL_EXTENSIONS)})""")
def _(t):
    suffix = F.when(F.col("doc_id") % 2 == 0, "?v=1.2").otherwise("#top")
    literal = t("F_paths").select("doc_id", F.concat("raw_path", suffix).alias("literal"))
    return literal.filter(P.is_asset_literal(F.col("literal")))


@query("p4_relative_id", """
    SELECT doc_id, replace(raw_path, chr(92), '/') AS id FROM $F_paths""")
def _(t):
    absolute = F.concat(F.lit("/home/dev/game/"), F.col("raw_path"))
    return t("F_paths").select("doc_id", P.relative_id(absolute, F.lit("/home/dev/game")).alias("id"))


@query("p5_resource_strip", """
    SELECT doc_id, regexp_replace(raw_path, '^res://', '') AS path FROM $F_paths""")
def _(t):
    return t("F_paths").select("doc_id", P.strip_resource_scheme(F.col("raw_path")).alias("path"))


@query("p6_asset_reference", f"""
    SELECT doc_id, nullif(array_to_string(list_filter({_SEGS}, lambda s: s NOT IN ('', '.', '..')), '/'), '') AS asset
    FROM $F_paths""")
def _(t):
    return t("F_paths").select("doc_id", P.asset_reference(F.col("raw_path")).alias("asset"))


@query("p7_patch_path", f"""
    SELECT doc_id, CASE WHEN list_contains({_SEGS}, '..') THEN NULL ELSE
      nullif(array_to_string(list_filter({_SEGS}, lambda s: s NOT IN ('', '.')), '/'), '') END AS patch_path
    FROM $F_paths""")
def _(t):
    return t("F_paths").select("doc_id", P.patch_path(F.col("raw_path")).alias("patch_path"))


@query("p8_containment", f"""
    SELECT doc_id, refusal, CASE WHEN refusal IS NULL THEN clean END AS relative_path FROM (
      SELECT doc_id, array_to_string(list_filter({_SEGS}, lambda s: s NOT IN ('', '.')), '/') AS clean,
        CASE WHEN trim(raw_path) = '' THEN 'empty_path'
          WHEN raw_path LIKE '/%' OR regexp_matches(replace(raw_path, chr(92), '/'), '^[A-Za-z]:/') THEN 'absolute_path'
          WHEN list_contains({_SEGS}, '..') THEN 'traversal' END AS refusal
      FROM $F_paths) c""")
def _(t):
    verdict = t("F_paths").select("doc_id", P.containment(F.col("raw_path")).alias("v"))
    return verdict.select("doc_id", "v.refusal", "v.relative_path")


_FOLD = """list_reduce(list_prepend('', string_split({path}, '/')), lambda a, s:
        CASE WHEN s IN ('', '.') THEN a WHEN a = '!' OR (s = '..' AND a = '') THEN '!'
          WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END)"""
_TARGET = """CASE WHEN specifier LIKE './%' OR specifier LIKE '../%'
  THEN {a} ELSE {b} END""".format(
    a=_FOLD.format(path="regexp_replace(path, '/[^/]*$', '') || '/' || specifier"),
    b=_FOLD.format(path="specifier"))


@query("p9_candidate_paths", f"""
    WITH base AS (SELECT project, path, l_orderkey, l_linenumber, specifier, substr({_TARGET}, 2) AS base FROM $F_imports
      WHERE specifier LIKE '.%' OR specifier LIKE '/%')
    SELECT project, path, specifier, c.candidate, c.priority FROM (
      SELECT project, path, specifier, unnest(CASE WHEN base LIKE '%.js' THEN
        [{{'priority': 0, 'candidate': base}}] || list_transform(['.ts', '.tsx', '.mts', '.cts'], lambda e, i:
          {{'priority': i, 'candidate': regexp_replace(base, '\\.js$', '') || e}})
        ELSE list_transform([{quoted(K.PROBED_EXTENSIONS)}], lambda e, i: {{'priority': i - 1, 'candidate': base || e}})
          || list_transform([{quoted(K.PROBED_EXTENSIONS)}], lambda e, i:
            {{'priority': i + 6, 'candidate': base || '/index' || e}}) END) AS c
      FROM (SELECT DISTINCT project, path, specifier, base FROM base) b) u""")
def _(t):
    from corpusgraph.operators import resolve
    distinct = t("F_imports").select("project", "path", "specifier").distinct()
    return resolve.candidates(distinct).select("project", "path", "specifier", "candidate", "priority")


@query("p10_relative_resolution", f"""
    SELECT page_id, href, CASE WHEN trim(href) = '' OR href LIKE '//%' OR regexp_matches(lower(href), '^[a-z][a-z0-9+.-]*:')
      THEN NULL ELSE nullif(nullif(CASE WHEN href LIKE '/%' THEN {_FOLD.format(path="href")}
        ELSE {_FOLD.format(path="'site/blog/' || href")} END, '!'), '') END AS target
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM $pages) l""")
def _(t):
    from corpusgraph.functions import markup
    links = t.table("pages").select(
        "page_id", F.explode(markup.tag_attribute(F.col("html"), "a", "href")).alias("href"))
    target = P.resolve_page_link(F.lit("site/blog/index.html"), F.col("href"))
    return links.select("page_id", "href", F.concat(F.lit("/"), target).alias("target"))


@query("p11_external_specifier", """
    SELECT specifier, count(*) AS n FROM $F_imports
    WHERE NOT (specifier LIKE '.%' OR specifier LIKE '/%') GROUP BY specifier""")
def _(t):
    external = t("F_imports").filter(P.is_external_specifier(F.col("specifier")))
    return external.groupBy("specifier").agg(F.count("*").alias("n"))


@query("p12_names", f"""
    SELECT doc_id, {_BASE} AS base_name, regexp_replace({_BASE}, '\\.[^.]*$', '') AS stem,
      CASE WHEN raw_path LIKE '%/%' THEN regexp_replace(raw_path, '/[^/]*$', '') ELSE '(project root)' END AS folder
    FROM $F_paths""")
def _(t):
    path = F.col("raw_path")
    return t("F_paths").select("doc_id", P.base_name(path).alias("base_name"), P.stem(path).alias("stem"),
                               P.folder(path).alias("folder"))


@query("p28_engine_detection", f"""
    SELECT project, CASE WHEN bool_or({_BASE} = 'project.godot') THEN 'Godot 4.x (GDScript)'
      WHEN bool_or({_EXT} = '.gd') THEN 'Godot 4.x (GDScript)' ELSE 'Three.js (WebGL) with HTML5 and Vite' END AS engine
    FROM $F_paths GROUP BY project""")
def _(t):
    return summary.engine_per_project(t("F_paths").select("project", F.col("raw_path").alias("path")))


@query("p29_language", f"""
    SELECT doc_id, CASE WHEN {_EXT} IN ('.js', '.mjs', '.cjs', '.jsx') THEN 'javascript'
      WHEN {_EXT} IN ('.ts', '.mts', '.cts') THEN 'typescript' WHEN {_EXT} = '.tsx' THEN 'tsx'
      WHEN {_EXT} = '.gd' THEN 'gdscript' END AS language FROM $F_paths""")
def _(t):
    return t("F_paths").select("doc_id", P.language(F.col("raw_path")).alias("language"))


@query("a3_files_by_extension", """
    SELECT extension, count(*) AS n FROM (SELECT CASE WHEN raw_path LIKE '%.%'
      THEN lower(regexp_extract(raw_path, '([^.]*)$', 1)) ELSE '(no extension)' END AS extension FROM $F_paths) e
    GROUP BY extension""")
def _(t):
    return summary.files_by_extension(t("F_paths").select(F.col("raw_path").alias("path")))


@query("a4_folder_map", """
    SELECT folder, n, sample, CASE WHEN n > 6 THEN '+' || CAST(n - 6 AS STRING) || ' more' ELSE '' END AS more FROM (
      SELECT folder, max(n) AS n, string_agg(raw_path, ', ' ORDER BY raw_path) AS sample FROM (
        SELECT raw_path, folder, count(*) OVER (PARTITION BY folder) AS n,
          row_number() OVER (PARTITION BY folder ORDER BY raw_path) AS rn
        FROM (SELECT raw_path, CASE WHEN raw_path LIKE '%/%' THEN regexp_replace(raw_path, '/[^/]*$', '')
          ELSE '(project root)' END AS folder FROM $F_paths) f) r
      WHERE rn <= 6 GROUP BY folder) g""")
def _(t):
    return summary.folder_map(t("F_paths").select(F.col("raw_path").alias("path")), sample=6)


@query("a7_prefab_modules", """
    SELECT project, raw_path AS path FROM $F_paths
    WHERE regexp_matches(raw_path, '(^|/)prefabs/[^/]+\\.(ts|js|mjs|cjs|jsx|tsx)$')
      AND NOT regexp_matches(raw_path, '(^|/)prefabs/index\\.(ts|js|mjs|cjs)$')""")
def _(t):
    return summary.prefab_modules(t("F_paths").select("project", F.col("raw_path").alias("path")))


@query("a14_language_mix", f"""
    SELECT project, count(*) AS files, count(*) FILTER (WHERE {_EXT} = '.js') AS javascript,
      count(*) FILTER (WHERE {_EXT} IN ('.ts', '.mts', '.cts')) AS typescript,
      count(*) FILTER (WHERE {_EXT} = '.gd') AS gdscript,
      count(*) FILTER (WHERE {_EXT} = '.tsx') AS tsx,
      max(len(string_split(raw_path, '/')) - 1) AS max_depth
    FROM $F_paths GROUP BY project""")
def _(t):
    return summary.language_mix(t("F_paths").select("project", F.col("raw_path").alias("path")))
