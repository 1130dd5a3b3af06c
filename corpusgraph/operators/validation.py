"""Validation jobs: documents, relations, parameters, slots, problem tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import documents as D
from corpusgraph.functions import slots as S
from corpusgraph.operators import hierarchy
from corpusgraph.plans.loops import cut
from corpusgraph.sources import scenes


def shape_problems(docs: DataFrame) -> DataFrame:
    """``(scene, path, message)`` of every shape issue in ``(scene, doc)`` rows."""
    return docs.select("scene", F.inline(D.shape_problems(F.col("doc"))))


def duplicate_ids(rows: DataFrame, list_name: str) -> DataFrame:
    """Later rows ``(scene, pos, id)`` with an id used before, citing the first index."""
    # A window, not a join with the first places: these are as many as the rows, and a planner that takes them for few broadcasts them.
    named = rows.select("scene", "pos", "id").filter("scene IS NOT NULL AND id IS NOT NULL")
    place = lambda c: F.concat(F.lit(list_name + "["), F.col(c).cast("string"), F.lit("]"))
    first = F.min("pos").over(Window.partitionBy("scene", "id"))
    return named.withColumn("first", first).filter("pos > first").select(
        "scene", F.concat(place("pos"), F.lit(".id")).alias("path"),
        F.concat(F.lit('duplicate id "'), "id", F.lit('" — first defined at '), place("first")).alias("message"))


def parent_problems(instances: DataFrame) -> DataFrame:
    """``(id, problem)``: one of self, missing, cycle per instance, tested in that order."""
    ids = instances.select(F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    cyclic = hierarchy.cycle_members(instances).withColumn("cyclic", F.lit(True))
    joined = instances.filter("parent IS NOT NULL").select("id", "parent").join(ids, "parent", "left").join(cyclic, "id", "left")
    problem = (
        F.when(F.col("parent") == F.col("id"), "self_parent")
        .when(F.col("known").isNull(), "missing_parent")
        .when(F.col("cyclic"), "cycle")
    )
    return joined.select("id", problem.alias("problem")).filter("problem IS NOT NULL")


def checked_documents(docs: DataFrame) -> DataFrame:
    """``(scene, doc, problems)``, written once: the shape rules are the costly part."""
    return cut(docs.select("scene", "doc", D.shape_problems(F.col("doc")).alias("problems")))


def document_problems(docs: DataFrame) -> DataFrame:
    """``(scene, path, message)`` of shape and, for documents of clean shape, relations."""
    checked = checked_documents(docs)
    return checked.select("scene", F.inline("problems")).unionByName(_relations(checked))


def relation_problems(docs: DataFrame) -> DataFrame:
    """``(scene, path, message)`` between instances, for documents of clean shape only."""
    return _relations(checked_documents(docs))


def _relations(checked: DataFrame) -> DataFrame:
    clean = checked.filter("size(problems) = 0").select("scene", "doc")
    rows = cut(scenes.instances(clean))
    firsts = rows.groupBy("scene", "id").agg(F.min_by("parent", "pos").alias("parent"))
    key = lambda c: F.concat_ws("\u0001", F.col("scene").cast("string"), F.col(c))
    chains = firsts.select(key("id").alias("id"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent"))
    cyclic = hierarchy.cycle_members(chains).withColumn("cyclic", F.lit(True))
    known = firsts.select("scene", F.col("id").alias("parent"), F.lit(True).alias("known"))
    joined = rows.filter("parent IS NOT NULL").join(known, ["scene", "parent"], "left").withColumn(
        "key", key("id")).join(cyclic.withColumnRenamed("id", "key"), "key", "left")
    message = (
        F.when(F.col("parent") == F.col("id"), F.concat(F.lit('instance "'), "id", F.lit('" parents itself')))
        .when(F.col("known").isNull(), F.concat(F.lit('parent "'), "parent", F.lit('" does not exist — no instance has that id')))
        .when(F.col("cyclic"), F.concat(F.lit('parent chain from "'), "id", F.lit('" is a cycle')))
    )
    parents = joined.select("scene", F.concat(F.lit("instances["), F.col("pos").cast("string"), F.lit("].parent")).alias("path"),
                            message.alias("message")).filter("message IS NOT NULL")
    return duplicate_ids(rows, "instances").unionByName(parents).unionByName(
        duplicate_ids(scenes.lights(clean), "lights"))


def valid_documents(docs: DataFrame) -> DataFrame:
    """Documents with neither shape nor relation problems."""
    checked = checked_documents(docs)
    good = checked.filter("size(problems) = 0").select("scene", "doc")
    return good.join(_relations(checked).select("scene").distinct(), "scene", "left_anti")


# --- parameters --------------------------------------------------------------
# A schema table has one row per (prefab, field): kind, min, max, exclusive_min,
# options, required, default_value, additional.

def _params(text: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.col(text)), "$", "map<string,variant>"),
                      F.create_map().cast("map<string,variant>"))


def parameter_problems(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """``(row_id, field, reason)``: the first failing rule per field, and unknown keys.

    ``rows`` holds ``(row_id, prefab, params)``; rows of unknown prefabs are skipped.
    """
    read = rows.select("row_id", "prefab", _params("params").alias("p"))
    joined = read.join(schema, "prefab")
    value = F.try_element_at("p", F.col("field"))
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    plain = F.try_variant_get(value, "$", "string")
    number = F.when(kind != "BOOLEAN", plain.try_cast("double"))
    empty = kind.isin("VOID") | (plain == "")
    title = F.col("field")
    reason = (
        F.when(empty, F.when(F.col("required"), F.concat(title, F.lit(" is required"))))
        .when((F.col("kind") == "number") & (number.isNull() | F.isnan(number)), F.concat(title, F.lit(" must be a finite number")))
        .when((F.col("kind") == "number") & F.col("exclusive_min") & (number <= F.col("min")),
              F.concat(title, F.lit(" must be greater than "), S.plain_number(F.col("min"))))
        .when((F.col("kind") == "number") & (number < F.col("min")), F.concat(title, F.lit(" must be at least "), S.plain_number(F.col("min"))))
        .when((F.col("kind") == "number") & (number > F.col("max")), F.concat(title, F.lit(" must be at most "), S.plain_number(F.col("max"))))
        .when((F.col("kind") == "string") & F.col("options").isNotNull() & ~F.array_contains(F.split("options", ","), plain),
              F.concat(title, F.lit(" must be one of: "), F.regexp_replace("options", ",", ", ")))
        .when((F.col("kind") == "boolean") & (kind != "BOOLEAN") & ~plain.isin("true", "false"), F.concat(title, F.lit(" must be a boolean")))
    )
    failing = joined.select("row_id", "field", reason.alias("reason")).filter("reason IS NOT NULL")
    extra = unknown_parameters(rows, schema)
    named = F.concat(F.lit('Unknown parameter "'), "field", F.lit('" is not allowed by schema'))
    return failing.unionByName(extra.select("row_id", "field", named.alias("reason")))


def _declared(schema: DataFrame) -> DataFrame:
    """One row per prefab: its fields and whether others are allowed. Bounded by a schema's fields."""
    return schema.groupBy("prefab").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.bool_or("additional").alias("open"))


def unknown_parameters(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """``(row_id, field)`` of keys the prefab does not declare, where it allows no others."""
    read = rows.select("row_id", "prefab", F.map_keys(_params("params")).alias("keys"))
    joined = read.join(_declared(schema), "prefab").filter("NOT open")
    return joined.select("row_id", F.explode(F.array_sort(F.array_except("keys", "fields"))).alias("field"))


def missing_parameters(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """``(row_id, field)`` required without a default and not set."""
    needed = schema.filter("required AND default_value IS NULL").groupBy("prefab").agg(F.collect_set("field").alias("needed"))
    read = rows.select("row_id", "prefab", F.map_keys(_params("params")).alias("keys"))
    return read.join(needed, "prefab").select("row_id", F.explode(F.array_except("needed", "keys")).alias("field"))


def effective_values(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """``(row_id, field, value)``: own value, else the default, else NULL."""
    read = rows.select("row_id", "prefab", _params("params").alias("p"))
    joined = read.join(schema.select("prefab", "field", "default_value"), "prefab")
    own = F.try_variant_get(F.try_element_at("p", F.col("field")), "$", "string")
    return joined.select("row_id", "field", F.coalesce(own, F.col("default_value")).alias("value"))


# --- slots -------------------------------------------------------------------

def slot_rejections(model: Column, size_kb: Column, actual: Column, expected: Column) -> Column:
    """``array<struct(kind, expectation)>`` sorted; a missing file ends the check.

    ``actual`` and ``expected`` are slot structs; NULL fields of the latter ask nothing.
    """
    def item(bad: Column, kind: str, expectation: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(kind).alias("kind"), expectation.alias("expectation")))

    quoted = lambda word, v: F.concat(F.lit(word + ' "'), v, F.lit('"'))
    none = F.array().cast("array<string>")
    single = F.filter(F.array(
        item(~actual["slot"].eqNullSafe(expected["slot"]) & expected["slot"].isNotNull(), "wrong_slot_type", quoted("slot", expected["slot"])),
        item(~actual["format"].eqNullSafe(expected["format"]) & expected["format"].isNotNull(), "wrong_slot_type", quoted("format", expected["format"])),
        item(expected["rigged"] & ~F.coalesce(actual["rigged"], F.lit(False)), "missing_rig", F.lit("a rigged model with a skeleton and skin")),
        item(size_kb > expected["max_size_kb"], "exceeds_max_size",
             F.concat(F.lit("at most "), S.plain_number(expected["max_size_kb"]), F.lit(" KB"))),
    ), lambda r: r.isNotNull())
    absent = F.transform(
        F.array_except(F.coalesce(expected["animations"], none), F.coalesce(actual["animations"], none)),
        lambda a: F.struct(F.lit("missing_animation").alias("kind"), quoted("animation", a).alias("expectation")))
    gone = F.array(F.struct(F.lit("file_not_found").alias("kind"), F.lit("an existing file").alias("expectation")))
    return F.when(size_kb.isNull(), gone).otherwise(F.array_sort(F.concat(single, absent)))


def has_expectations(slot: Column, path: Column) -> Column:
    """A slot made of defaults only asks nothing."""
    default = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    return (slot["animations"].isNotNull() | slot["rigged"].isNotNull() | slot["max_size_kb"].isNotNull()
            | slot["dimensions"].isNotNull() | F.coalesce(slot["format"] != default, F.lit(False)))


# --- problem tables ----------------------------------------------------------

def unknown_prefabs(instances: DataFrame, prefabs: DataFrame) -> DataFrame:
    message = F.concat(F.lit('no registered prefab named "'), "prefab", F.lit('"'))
    return instances.join(prefabs.select("prefab").distinct(), "prefab", "left_anti").select("id", "prefab", message.alias("message"))


def later_definitions(definitions: DataFrame) -> DataFrame:
    """``(prefab, seq, first)``: definitions after the first of their name."""
    first = definitions.groupBy("prefab").agg(F.min("seq").alias("first"))
    return definitions.join(first, "prefab").filter("seq > first").select("prefab", "seq", "first")


def new_problems(problems: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """Problems not reported before, once each."""
    return problems.join(reported.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def grouped_problems(problems: DataFrame) -> DataFrame:
    """``(owner, field, reason)``: per field the last one; field NULL joins the distinct
    reasons of the owner with a space, in first-seen order."""
    fields = problems.filter("field IS NOT NULL").groupBy("owner", "field").agg(F.max_by("reason", "seq").alias("reason"))
    once = problems.filter("field IS NULL").groupBy("owner", "reason").agg(F.min("seq").alias("seq"))
    loose = once.groupBy("owner").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda r: r["reason"]), " ").alias("reason"))
    return fields.unionByName(loose.select("owner", F.lit(None).cast("string").alias("field"), "reason"))


def collected_problems(*parts: DataFrame) -> DataFrame:
    """Union of ``(scope, text)`` problems; repeated text gives one row."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("text").agg(F.min("scope").alias("scope"))


def scoped_problems(problems: DataFrame, instance: Column | str | int) -> DataFrame:
    """Problems of one instance: its own rows, and plain text that names no other instance."""
    wanted = instance if isinstance(instance, Column) else F.lit(instance)
    named = F.regexp_extract("text", r'instance "([^"]+)"', 1)
    own = F.col("instance_id").eqNullSafe(wanted)
    plain = F.col("scope") == "text"
    return problems.filter(own | (plain & ((named == "") | (named == wanted.cast("string")))))
