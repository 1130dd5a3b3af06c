"""Typed graphs from source tables ``(project, path, content)``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import code, markup, sections
from corpusgraph.functions import paths as P
from corpusgraph.operators import resolve
from corpusgraph.sources.declared import autoload_rows


def module_imports(files: DataFrame) -> DataFrame:
    rows = files.select("project", "path", F.posexplode(code.imports(F.col("content"))).alias("i", "m"))
    return rows.select("project", "path", (F.col("i") + 1).alias("ord"), "m.specifier", "m.names", "m.dynamic")


def module_exports(files: DataFrame) -> DataFrame:
    rows = files.select("project", "path", F.explode(code.exports(F.col("content"))).alias("e"))
    return rows.select("project", "path", "e.kind", "e.name", "e.parameters", "e.returns")


def module_assets(files: DataFrame) -> DataFrame:
    rows = files.select("project", "path", F.explode(code.asset_literals(F.col("content"))).alias("raw"))
    return rows.select("project", "path", P.asset_reference(F.col("raw")).alias("asset")).filter("asset IS NOT NULL")


def page_scripts(pages: DataFrame, known: DataFrame, tag: str = "script", attribute: str = "src") -> DataFrame:
    """``(project, path, script)``: distinct local scripts of each page that exist.

    A page that names ``x.js`` may mean its typed twin, tried after the exact name.
    """
    links = pages.filter(F.lower("path").rlike(r"\.html?$")).select(
        "project", "path", F.explode(markup.tag_attribute(F.col("content"), tag, attribute)).alias("link"))
    based = links.select("project", "path", P.resolve_page_link(F.col("path"), F.col("link")).alias("base"))
    based = based.filter("base IS NOT NULL").distinct()
    tried = based.select("project", "path", "base", F.posexplode(P.exact_or_typed(F.col("base"))).alias("priority", "candidate"))
    hit = tried.join(known.select("project", F.col("path").alias("candidate")).distinct(), ["project", "candidate"])
    best = hit.groupBy("project", "path", "base").agg(F.min_by("candidate", "priority").alias("script"))
    return best.select("project", "path", "script").distinct()


def module_graph(files: DataFrame, assets: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Nodes, edges and missing assets of module projects.

    ``assets`` holds ``(project, asset)`` of the assets that exist. Each result is a
    plan of its own; cache ``files`` when several are read.
    """
    modules = files.filter(P.has_extension(F.col("path"), K.MODULE_EXTENSIONS))
    known = modules.select("project", "path").unionByName(
        assets.filter(P.is_asset(F.col("asset"))).select("project", F.col("asset").alias("path")))
    imported = resolve.import_edges(resolve.resolve_imports(module_imports(modules), known))
    references = module_assets(modules)
    edges = imported.unionByName(resolve.asset_edges(references, assets))
    nodes = modules.select("project", F.col("path").alias("id"), F.lit("module").alias("type"))
    used = references.join(assets, ["project", "asset"], "left_semi").select(
        "project", F.col("asset").alias("id"), F.lit("asset").alias("type")).distinct()
    nodes = nodes.unionByName(used)
    if pages is not None:
        scripts = page_scripts(pages, modules.select("project", "path"))
        edges = edges.unionByName(scripts.select(
            "project", F.col("path").alias("src"), F.col("script").alias("dst"), F.lit("import").alias("kind")))
        nodes = nodes.unionByName(pages.select("project", F.col("path").alias("id"), F.lit("scene").alias("type")))
    return {"nodes": nodes, "edges": edges, "missing": resolve.missing_assets(references, assets)}


def single_module(files: DataFrame, path: str, assets: DataFrame) -> DataFrame:
    """Dependencies of one module: assets only, since other modules are not read."""
    one = files.filter(F.col("path") == path)
    existing = assets.filter(P.is_asset(F.col("asset")))
    imported = resolve.resolve_imports(module_imports(one), existing.select("project", F.col("asset").alias("path")))
    named = module_assets(one).select("project", "path", F.col("asset").alias("dst"))
    return imported.select("project", "path", F.col("target").alias("dst")).unionByName(named).distinct()


# --- section-text projects ---------------------------------------------------

def section_rows(scenes: DataFrame) -> DataFrame:
    rows = scenes.select("project", "path", F.posexplode(sections.sections(F.col("content"))).alias("i", "s"))
    return rows.select("project", "path", (F.col("i") + 1).alias("section_no"), "s.line", "s.kind",
                       "s.attributes", "s.properties")


def external_resources(scenes: DataFrame) -> DataFrame:
    rows = section_rows(scenes).filter(F.col("kind") == "ext_resource")
    value = F.col("attributes")
    return rows.select(
        "project", "path", sections.attribute(value, "id").alias("id"),
        F.coalesce(sections.attribute(value, "type"), F.lit("Unknown")).alias("type"),
        P.strip_resource_scheme(sections.attribute(value, "path")).alias("target")).filter("target IS NOT NULL")


def connections(scenes: DataFrame) -> DataFrame:
    rows = section_rows(scenes).filter(F.col("kind") == "connection")
    return rows.select("project", "path", sections.attribute(F.col("attributes"), "from").alias("source"))


def valid_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes whose text has no malformed header."""
    return scenes.filter(F.size(sections.section_errors(sections.sections(F.col("content")))) == 0)


def root_scripts(scenes: DataFrame) -> DataFrame:
    """``(project, path, root_script)``; NULL when no node carries a known external script."""
    parsed = scenes.select("project", "path", sections.sections(F.col("content")).alias("s"))
    named = parsed.select("project", "path", "s", sections.root_script_id(F.col("s")).alias("root_id"))
    wanted = F.filter("s", lambda r: (r["kind"] == "ext_resource")
                      & (sections.attribute(r["attributes"], "id") == F.col("root_id")))
    target = P.strip_resource_scheme(sections.attribute(F.get(wanted, F.lit(0))["attributes"], "path"))
    return named.select("project", "path", target.alias("root_script"))


def script_contracts(scripts: DataFrame) -> DataFrame:
    """``(project, path, exports, signals)`` with formatted, sorted signatures."""
    read = scripts.select("project", "path", code.script_contract(F.col("content")).alias("c"))
    return read.select(
        "project", "path",
        code.script_signatures(F.col("c"), ["export", "const", "enum", "function"]).alias("exports"),
        code.script_signatures(F.col("c"), ["signal"]).alias("signals"))


def script_identifiers(scripts: DataFrame) -> DataFrame:
    return scripts.select("project", "path", F.explode(code.identifiers(F.col("content"))).alias("name"))


def scene_graph(scenes: DataFrame, scripts: DataFrame, settings: DataFrame) -> DataFrame:
    """Edges of section-text projects: resources, signals and autoload requirements."""
    sound = valid_scenes(scenes)
    known = scenes.select("project", "path").unionByName(scripts.select("project", "path"))
    resources = external_resources(sound)
    required = resolve.autoload_requirements(script_identifiers(scripts), autoload_rows(settings))
    return (
        resolve.resource_edges(resources, known)
        .unionByName(resolve.signal_edges(connections(sound), resources, known))
        .unionByName(required.select("project", F.col("path").alias("src"), F.col("target").alias("dst"),
                                     F.lit("requires").alias("kind")))
    )


def single_scene(scenes: DataFrame, path: str) -> DataFrame:
    """Every external resource of one scene, existing or not."""
    return external_resources(scenes.filter(F.col("path") == path)).select(
        "project", "path", F.col("target").alias("dst")).distinct()
