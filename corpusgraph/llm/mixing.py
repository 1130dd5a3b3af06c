"""Mixing sources to target weights by capped water-filling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.order import with_running_sum
from corpusgraph.plans.loops import RoundLimit, cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: float, max_rounds: int = 10_000) -> DataFrame:
    """Adds ``target`` to ``sources (source_size, weight)``.

    All sizes together are shared by weight. A share above ``epochs`` times its
    source's size is clamped there and the excess is shared again by weight among the
    others, until no share is too large. The level (what is left over the weight that
    is left) only rises, so one aggregate per round over the sources decides who is
    clamped; nothing but those sums comes to the driver.
    """
    cap = F.col("source_size") * F.lit(epochs)
    start = sources.agg(F.sum("source_size").cast("double").alias("left"), F.sum("weight").cast("double").alias("weight")).first()
    left, weight, clamped = start["left"] or 0.0, start["weight"] or 1.0, 0
    for _ in range(max_rounds):
        over = F.lit(left) * F.col("weight") / F.lit(weight) > cap
        now = sources.agg(
            F.count_if(over).alias("clamped"), F.sum(F.when(~over, F.col("weight"))).cast("double").alias("weight"),
            (F.sum("source_size") - F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0))).cast("double").alias("left")).first()
        if not now["clamped"] or now["clamped"] == clamped or not now["weight"]:
            return sources.withColumn("target", F.when(over, cap).otherwise(
                F.lit(left) * F.col("weight") / F.lit(weight)).cast("double"))
        left, weight, clamped = now["left"], now["weight"], now["clamped"]
    raise RoundLimit(f"shares still changing after {max_rounds} rounds")


def mix(docs: DataFrame, size: Column, id_column: str = "doc_id", source_column: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Sources weigh ``weights`` in turn, by code point, a null source last, and share the
    sum of all sizes (:func:`water_fill`). A source with target / size = 2.4 takes every
    document twice, and 0.4 of its size once more: documents in the order of a seeded
    hash, each one whose middle lies before 0.4 of the size. So the words taken miss the
    target by half a document at most, no document is taken more than ``epochs``
    times, and reruns agree.

    The order inside a source is settled on 65,536 hash ranges per source; documents are
    ranked only inside the one range in which the fraction ends.

    Returns ``id, source, size, source_size, target, repeats, taken`` and the columns
    in ``keep``. Nulls: a null source is a source of its own; a null or negative size counts
    as 0; null ids are ordered by size. Repeated rows count as rows. A source without
    words has target 0 and is taken 0 times. An empty table gives an empty result.
    """
    marked = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("null"), F.col("size").cast("string")))
    sizes = cut(docs.withColumn("size", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")).select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), "size", *(keep or []),
        F.md5(F.concat(F.lit(f"{seed}:"), marked)).alias("_hash")).withColumn("_range", F.substring("_hash", 1, 4)))
    totals = sizes.groupBy("source", "_range").agg(F.sum("size").alias("range_size"))
    totals = cut(totals)
    sources = totals.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    numbered = with_running_sum(sources, [F.col("source").asc_nulls_last()], F.lit(1), "place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = cut(water_fill(cut(numbered.withColumn("weight", turn)), epochs))
    rate = F.col("target") / F.greatest("source_size", F.lit(1))
    plan = filled.select(
        F.col("source").alias("s"), "source_size", "target", F.floor(rate).cast("long").alias("whole"),
        ((rate - F.floor(rate)) * F.col("source_size")).alias("need"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = totals.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).join(
        plan.select("s", "need"), F.col("source").eqNullSafe(F.col("s"))).filter(
        (F.col("range_start") <= F.col("need")) & (F.col("range_start") + F.col("range_size") > F.col("need"))).select(
        F.col("source").alias("s"), F.col("_range").alias("end_range"), "range_start")
    plan = cut(plan.join(ends.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"))
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("s")))
    inside = Window.partitionBy("source").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_end = rows.filter("_range = end_range").withColumn(
        "middle", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2).withColumn(
        "more", (F.col("middle") <= F.col("need")) & (F.col("need") > 0)).drop("middle")
    elsewhere = rows.filter("_range <> end_range OR end_range IS NULL").withColumn(
        "more", F.coalesce((F.col("_range") < F.col("end_range")) & (F.col("need") > 0), F.lit(False)))
    taken = at_end.unionByName(elsewhere).withColumn("repeats", F.col("whole") + F.col("more").cast("long"))
    return taken.select("id", "source", "size", "source_size", "target", "repeats",
                        (F.col("size") * F.col("repeats")).alias("taken"), *(keep or []))
