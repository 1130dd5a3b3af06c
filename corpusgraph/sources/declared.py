"""Declarations that sit next to the code: slots, packages, autoloads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import sections
from corpusgraph.functions import slots as S
from corpusgraph.plans.loops import by_shuffle


def companion_slots(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Companion JSON per asset: ``<asset>.slot.json`` first, then ``<stem>.slot.json``."""
    usable = files.filter(S.is_json_object(F.col("content")))
    keys = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat("path", F.lit(".slot.json")).alias("key")),
        F.struct(F.lit(1).alias("rank"), F.regexp_replace("path", r"\.[^/.]+$", ".slot.json").alias("key")),
    )
    tried = assets.select("path", F.inline(keys))
    found = tried.join(by_shuffle(usable.select(F.col("path").alias("key"), "content")), "key")
    best = found.groupBy("path").agg(F.min_by("content", "rank").alias("companion"))
    return assets.join(by_shuffle(best), "path", "left")


def registry_slots(assets: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry JSON per asset from ``(registry_rank, key, value)`` rows.

    The first registry with one of the keys id, stem or base name decides.
    """
    path = F.col("path")
    keys = F.array(
        F.struct(F.lit(0).alias("rank"), path.alias("key")),
        F.struct(F.lit(1).alias("rank"), S.slot_stem(path).alias("key")),
        F.struct(F.lit(2).alias("rank"), F.substring_index(path, "/", -1).alias("key")),
    )
    tried = assets.select("path", F.inline(keys)).groupBy("path", "key").agg(F.min("rank").alias("rank"))
    found = tried.join(by_shuffle(entries), "key")
    first_key = found.groupBy("path", "registry_rank").agg(F.min_by("value", "rank").alias("value"))
    usable = first_key.filter(S.is_json_object(F.col("value")))
    best = usable.groupBy("path").agg(F.min_by("value", "registry_rank").alias("registry"))
    return assets.join(by_shuffle(best), "path", "left")


def package_names(text: Column, part: str) -> Column:
    """Sorted dependency names of one part of a package manifest; empty for bad JSON."""
    found = F.json_object_keys(F.get_json_object(text, f"$.{part}"))
    return F.coalesce(F.array_sort(found), F.array().cast("array<string>"))


def autoload_rows(settings: DataFrame) -> DataFrame:
    """``(project, name, target)``; a later entry of one name replaces an earlier one."""
    rows = settings.select("project", F.posexplode(sections.autoloads(F.col("content"))).alias("i", "a"))
    return rows.groupBy("project", F.col("a.name").alias("name")).agg(
        F.max_by(F.col("a.path"), F.col("i")).alias("target"))
