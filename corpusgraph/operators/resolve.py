"""Reference resolution: joins of references with the files that exist.

Right sides hold one row per key, so a hot reference makes only the left side
large; AQE splits such a partition. Left sides are de-duplicated first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import paths as P
from corpusgraph.functions import slots as S
from corpusgraph.functions.exprs import strings


def candidates(imports: DataFrame) -> DataFrame:
    """Rows of ``imports`` times the paths each specifier may mean, with a priority."""
    local = imports.filter(~P.is_external_specifier(F.col("specifier")))
    based = local.withColumn("_base", P.resolve_relative(F.col("path"), F.col("specifier")))
    exploded = based.filter(F.col("_base").isNotNull()).withColumn(
        "_c", F.explode(P.candidate_paths(F.col("_base")))
    )
    return exploded.select(
        "*", F.col("_c.candidate").alias("candidate"), F.col("_c.priority").alias("priority")
    ).drop("_base", "_c")


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """``(project, path, specifier, n, target)``: the first candidate that exists.

    ``known`` holds ``(project, path)`` of modules and existing assets. Each of them is
    listed under the few bases it answers, the best file per base is kept, and every
    import meets at most one row. ``n`` counts the equal import rows.
    """
    counted = imports.filter(~P.is_external_specifier(F.col("specifier"))).groupBy(
        "project", "path", "specifier").agg(F.count("*").alias("n"))
    based = counted.withColumn("base", P.resolve_relative(F.col("path"), F.col("specifier")))
    answers = known.select("project", F.col("path").alias("target"), F.inline(P.satisfied_bases(F.col("path"))))
    best = answers.groupBy("project", "base").agg(F.min_by("target", "priority").alias("target"))
    return based.join(best, ["project", "base"]).select("project", "path", "specifier", "n", "target")


def import_edges(resolved: DataFrame) -> DataFrame:
    """One edge per import row, duplicates kept."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    return resolved.select("project", F.col("path").alias("src"), F.col("target").alias("dst"),
                           F.lit("import").alias("kind"), copies).drop("copy")


def asset_edges(references: DataFrame, assets: DataFrame) -> DataFrame:
    """One edge per (file, asset) for the assets that exist."""
    wanted = references.select("project", "path", "asset").distinct()
    return wanted.join(assets.select("project", "asset"), ["project", "asset"], "left_semi").select(
        "project", F.col("path").alias("src"), F.col("asset").alias("dst"), F.lit("asset_ref").alias("kind"))


def missing_assets(references: DataFrame, assets: DataFrame) -> DataFrame:
    """Referenced assets that do not exist, with the reason in words."""
    gone = references.join(assets.select("project", "asset"), ["project", "asset"], "left_anti")
    reason = F.concat(F.col("path"), F.lit(" references "), F.col("asset"), F.lit(", which does not exist"))
    return gone.select("project", "path", "asset", reason.alias("reason"))


def autoload_requirements(identifiers: DataFrame, autoloads: DataFrame) -> DataFrame:
    """``(project, path, name, target)`` for scripts that mention an autoload name."""
    return identifiers.join(autoloads, ["project", "name"]).select("project", "path", "name", "target")


def resource_edges(resources: DataFrame, known: DataFrame) -> DataFrame:
    """Edges to external resources: assets always, other files only when known."""
    found = known.select("project", F.col("path").alias("target"), F.lit(True).alias("known")).distinct()
    joined = resources.join(found, ["project", "target"], "left")
    kind = F.when(P.is_asset(F.col("target")), "asset_ref").when(F.col("known"), "ext_resource")
    return joined.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "project", F.col("path").alias("src"), F.col("target").alias("dst"), "kind")


def signal_edges(connections: DataFrame, resources: DataFrame, known: DataFrame) -> DataFrame:
    """Edges to the one packed scene whose name equals the signal source, once each."""
    packed = resources.filter(F.col("type") == "PackedScene").select(
        "project", "path", F.lower(P.stem(F.col("target"))).alias("name"), "target")
    unique = packed.groupBy("project", "path", "name").agg(
        F.count("*").alias("n"), F.first("target").alias("target")).filter("n = 1")
    named = connections.filter(F.col("source") != ".").select(
        "project", "path", F.lower("source").alias("name")).distinct()
    hit = named.join(unique, ["project", "path", "name"])
    exists = hit.join(known.select("project", F.col("path").alias("target")).distinct(),
                      ["project", "target"], "left_semi")
    return exists.select("project", F.col("path").alias("src"), F.col("target").alias("dst"),
                         F.lit("signal_connection").alias("kind")).dropDuplicates(["project", "src", "dst", "kind"])


def inherit_contracts(scenes: DataFrame, contracts: DataFrame) -> DataFrame:
    """A scene takes exports and signals of its root script; it requires nothing."""
    scripts = contracts.select("project", F.col("path").alias("root_script"), "exports", "signals")
    empty = F.array().cast("array<string>")
    return scenes.join(scripts, ["project", "root_script"], "left").select(
        "project", "path", F.coalesce("exports", empty).alias("exports"),
        F.coalesce("signals", empty).alias("signals"), empty.alias("requires"))


def resolve_slots(assets: DataFrame) -> DataFrame:
    """Companion, registry, hint or default: the first source wins whole.

    Expects ``companion`` and ``registry`` JSON texts and a ``hint`` struct.
    """
    path = F.col("path")
    default = F.struct(
        S.slot_stem(path).alias("slot"), F.regexp_replace(P.extension(path), r"^\.", "").alias("format"),
        F.lit(None).cast("array<string>").alias("animations"), F.lit(None).cast("string").alias("dimensions"),
        F.lit(None).cast("boolean").alias("rigged"), F.lit(None).cast("double").alias("max_size_kb"))
    source = (
        F.when(F.col("companion").isNotNull(), "companion")
        .when(F.col("registry").isNotNull(), "registry")
        .when(F.col("hint").isNotNull(), "hint")
        .otherwise("default")
    )
    raw = F.coalesce(
        F.when(F.col("companion").isNotNull(), S.raw_slot(F.col("companion"))),
        F.when(F.col("registry").isNotNull(), S.raw_slot(F.col("registry"))),
        F.col("hint").cast(S.SLOT_TYPE),
        default,
    )
    return assets.withColumn("source", source).withColumn("_raw", raw).withColumn(
        "slot", S.normalize(F.col("_raw"), path)).drop("_raw")


def slot_hints(files: DataFrame) -> DataFrame:
    """``(path, asset, hint)``: per field the last hint of a file that sets it."""
    rows = files.select("path", F.explode(S.hints(F.col("content"))).alias("h"))
    names = ["slot", "format", "animations", "dimensions", "rigged", "max_size_kb"]
    picks = []
    for name in names:
        value = F.col(f"h.slot.{name}")
        picks.append(F.max_by(value, F.when(value.isNotNull(), F.col("h.seq"))).alias(name))
    merged = rows.groupBy("path", F.col("h.asset").alias("asset")).agg(*picks)
    return merged.select("path", "asset", F.struct(*names).alias("hint"))


def import_policy(imports: DataFrame, forbidden: list[str], root: str,
                  substrings: list[str] | None = None) -> DataFrame:
    """Violations of three import rules. The rule lists are parameters, so no join is needed."""
    spec = F.col("specifier")
    banned = F.exists(strings(forbidden), lambda n: (spec == n) | spec.startswith(F.concat(n, F.lit("/"))))
    bare = F.array_join(F.slice(F.split(spec, "/"), 1, 2), "/")
    plain = ~(spec.startswith(".") | spec.startswith("node:") | spec.startswith("@"))
    smells = plain & F.exists(strings(substrings or K.FORBIDDEN_SUBSTRINGS), lambda n: F.contains(bare, n))
    target = P.resolve_relative(F.col("path"), spec)
    escapes = spec.startswith(".") & ~F.coalesce(target.startswith(root), F.lit(False))
    rules = F.array(F.when(banned, "forbidden_package"), F.when(smells, "forbidden_name"),
                    F.when(escapes, "escapes_root"))
    return imports.withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull())))


def pinned_versions(manifests: DataFrame, package: str) -> DataFrame:
    """``(project, version, problem)``: missing, a range, or unreadable; NULL when exact."""
    version = F.coalesce(F.get_json_object("package_json", f"$.dependencies.{package}"),
                         F.get_json_object("package_json", f"$.devDependencies.{package}"))
    problem = (
        F.when(~S.is_json_object(F.col("package_json")), "unreadable")
        .when(version.isNull(), "missing")
        .when(version.rlike(r"[\^~><=x*]|\s-\s"), "range")
    )
    return manifests.select("project", version.alias("version"), problem.alias("problem"))


def version_consistency(pins: DataFrame) -> DataFrame:
    """One row: how many exact versions are in use, and whether they agree."""
    exact = F.count_distinct(F.when(F.col("problem").isNull(), F.col("version")))
    return pins.agg(exact.alias("versions"), (exact <= 1).alias("consistent"))


def created_or_overwritten(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Mark each block's target as new or existing, inside its project where both tables say which."""
    keys = ["project", "path"] if "project" in blocks.columns and "project" in files.columns else ["path"]
    known = files.select(*keys, F.lit(True).alias("known")).distinct()
    return blocks.join(known, keys, "left").withColumn(
        "outcome", F.when(F.col("known"), "overwritten").otherwise("created")).drop("known")
