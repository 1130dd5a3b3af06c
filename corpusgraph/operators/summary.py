"""Aggregates over files, nodes, edges and problems."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import paths as P
from corpusgraph.sources.files import top_per_group


def engine_per_project(files: DataFrame) -> DataFrame:
    """Engine label per project from its files."""
    godot = F.bool_or((P.base_name(F.col("path")) == "project.godot")
                      | (P.extension(F.col("path")) == ".gd"))
    return files.groupBy("project").agg(
        F.when(godot, "Godot 4.x (GDScript)")
        .otherwise("Three.js (WebGL) with HTML5 and Vite")
        .alias("engine")
    )


def files_by_extension(files: DataFrame) -> DataFrame:
    path = F.col("path")
    name = F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise(
        "(no extension)"
    )
    return files.groupBy(name.alias("extension")).agg(F.count("*").alias("n"))


def folder_map(files: DataFrame, sample: int) -> DataFrame:
    """Per folder: number of files, the first few in order, and how many more.

    Counting and sampling are separate so that neither collects a whole folder:
    counts combine on the map side, the sample is a top-k per folder.
    """
    placed = files.withColumn("folder", P.folder(F.col("path")))
    counts = placed.groupBy("folder").agg(F.count("*").alias("n"))
    first = top_per_group(placed.select("folder", "path"), ["folder"], [F.col("path")], sample)
    shown = first.groupBy("folder").agg(
        F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("sample")
    )
    more = F.when(F.col("n") > sample, F.concat(F.lit("+"), F.col("n") - sample, F.lit(" more")))
    return counts.join(shown, "folder").select("folder", "n", "sample", F.coalesce(more, F.lit("")).alias("more"))


def prefab_modules(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.filter(
        path.rlike(r"(^|/)prefabs/[^/]+\.(ts|js|mjs|cjs|jsx|tsx)$")
        & ~path.rlike(r"(^|/)prefabs/index\.(ts|js|mjs|cjs)$")
    )


def language_mix(files: DataFrame) -> DataFrame:
    """File count, languages and deepest folder in one row per project."""
    language = P.language(F.col("path"))
    return files.groupBy("project").agg(
        F.count("*").alias("files"),
        *[F.count_if(language == name).alias(name)
          for name in ("javascript", "typescript", "gdscript", "tsx")],
        F.max(P.depth(F.col("path"))).alias("max_depth"),
    )
