"""Edits of instance tables ``(id, prefab, name, parent, ...)``."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.plans.loops import cut, jump_to_end


def merge_params(old: Column, new: Column, replace: Column | bool = False) -> Column:
    """Shallow merge of two ``map<string,string>``, or the new one alone."""
    merged = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
    return F.when(F.lit(replace) if isinstance(replace, bool) else replace, new).otherwise(merged)


def set_transforms(instances: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``(seq, id, position, rotation, scale)``; NULL components stay as they are.

    Several edits of one instance count in order: per component the last one given
    wins. Returns the instances and ``(seq, id, error)`` of unknown ids.
    """
    parts = ("position", "rotation", "scale")
    last = edits.groupBy("id").agg(*[
        F.max_by(F.col(p), F.when(F.col(p).isNotNull(), F.col("seq"))).alias(f"new_{p}") for p in parts])
    moved = instances.join(last, "id", "left")
    for p in parts:
        moved = moved.withColumn(p, F.coalesce(f"new_{p}", p)).drop(f"new_{p}")
    return moved, _unknown(instances, edits)


def _unknown(instances: DataFrame, edits: DataFrame) -> DataFrame:
    error = F.concat(F.lit('no instance with id "'), F.col("id").cast("string"), F.lit('"'))
    return edits.join(instances.select("id").distinct(), "id", "left_anti").select("seq", "id", error.alias("error"))


def swap_models(instances: DataFrame, edits: DataFrame, validator: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(seq, id, model, error)`` of ``(seq, id, model)`` edits.

    ``validator`` turns the edit's columns into a reason for refusal or NULL. It
    returns a column, so the planner still sees through it.
    """
    ids = instances.select("id", F.lit(True).alias("known")).distinct()
    joined = edits.join(ids, "id", "left")
    refused = F.lit(None).cast("string") if validator is None else validator(F.col("model"))
    error = (
        F.when(F.col("known").isNull(), F.concat(F.lit('no instance with id "'), F.col("id").cast("string"), F.lit('"')))
        .when(F.trim("model") == "", "model path must not be empty")
        .otherwise(refused)
    )
    return joined.select("seq", "id", "model", error.alias("error"))


def add_instances(instances: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append rows with unused ids; the first of several equal new ids is taken."""
    firsts = new.groupBy("id").agg(F.min("seq").alias("first"))
    ids = instances.select("id", F.lit(True).alias("used")).distinct()
    marked = cut(new.join(firsts, "id").join(ids, "id", "left"))
    good = marked.filter("used IS NULL AND seq = first").select(*instances.columns)
    error = F.concat(F.lit('instance id "'), F.col("id").cast("string"), F.lit('" is already used in this scene'))
    bad = marked.filter("used OR seq <> first").select("seq", "id", error.alias("error"))
    return instances.unionByName(good), bad


def remove_instances(instances: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop rows; children move up to the nearest ancestor that stays.

    Below a removed root they keep that root as a dangling parent. The order of the
    removals makes no difference, so all of them are done at once.
    """
    gone = cut(instances.join(removed.select("id").distinct(), "id", "left_semi").select("id", "parent"))
    inner = gone.select(F.col("id").alias("parent"), F.lit(True).alias("inner"))
    chain = gone.join(inner, "parent", "left").select("id", F.when(F.col("inner"), F.col("parent")).alias("parent"))
    ends = jump_to_end(chain).select("id", "root")
    # Above the topmost removed node of a run: its parent, or the node itself for a root.
    above = ends.join(gone.select(F.col("id").alias("root"), F.col("parent").alias("up")), "root").select(
        F.col("id").alias("parent"), F.coalesce("up", "root").alias("new_parent"))
    kept = instances.join(gone.select("id"), "id", "left_anti").join(above, "parent", "left")
    return kept.withColumn("parent", F.coalesce("new_parent", "parent")).select(*instances.columns)


def dispatch(instances: DataFrame, edits: DataFrame) -> DataFrame:
    """``(seq, id, op, error)``: which of the ordered edits take effect.

    After any add an id is in use, after any removal it is not, whether or not that
    edit itself was refused. So the last add or removal before an edit tells if its
    instance is there, and no fold over the edits is needed.
    """
    ids = instances.select("id", F.lit(True).alias("initially")).distinct()
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.when(F.col("op") == "addInstance", True).when(F.col("op") == "removeInstance", False)
    present = F.coalesce(F.last(sets, ignorenulls=True).over(before), F.col("initially"), F.lit(False))
    rows = edits.join(ids, "id", "left").withColumn("present", present)
    ops = ("setTransform", "swapModel", "addInstance", "removeInstance", "setParams")
    error = (
        F.when(~F.col("op").isin(*ops), "unknown edit")
        .when((F.col("op") == "addInstance") & F.col("present"), "already used")
        .when((F.col("op") != "addInstance") & ~F.col("present"), "no instance")
    )
    return rows.select("seq", "id", "op", error.alias("error"))


def editable(instances: DataFrame) -> DataFrame:
    """``(id, editable, reason)``; locked rows refuse edits."""
    locked = F.coalesce("locked", F.lit(False))
    return instances.select("id", (~locked).alias("editable"), F.when(
        locked, "this instance is locked: edits are blocked until it is unlocked").otherwise("").alias("reason"))


def build_failures(instances: DataFrame, prefabs: DataFrame) -> DataFrame:
    """``(id, kind)`` for unknown prefabs and dangling parents; others are untouched."""
    known = prefabs.select("prefab").distinct()
    unknown = instances.join(known, "prefab", "left_anti").select("id", F.lit("unknown-prefab").alias("kind"))
    ids = instances.select(F.col("id").alias("parent")).distinct()
    dangling = instances.filter("parent IS NOT NULL").join(ids, "parent", "left_anti").select(
        "id", F.lit("dangling-parent").alias("kind"))
    return unknown.unionByName(dangling)


def profile(instances: DataFrame) -> DataFrame:
    """Instances and parented instances per prefab."""
    return instances.groupBy("prefab").agg(F.count("*").alias("n"), F.count_if(F.col("parent").isNotNull()).alias("parented"))
