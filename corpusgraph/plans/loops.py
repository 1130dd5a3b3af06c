"""Loops over DataFrames with lineage cut in reliable storage."""

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusgraph.session import checkpoint_folder

HOT_DEGREE = 1_000_000


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to a table in the checkpoint folder and read it back.

    The new frame has no lineage and no inherited plan constraints, survives the loss
    of executors, and its file sizes tell the planner which side is small.
    """
    spark = frame.sparkSession
    place = f"{checkpoint_folder(spark).rstrip('/')}/corpusgraph/{uuid.uuid4().hex}"
    frame.write.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)


def cut_dealt(frame: DataFrame, key: str) -> DataFrame:
    """:func:`cut`, dealt by ``key`` into as many buckets as a shuffle has partitions: joins on the key do not shuffle this side."""
    spark = frame.sparkSession
    name = uuid.uuid4().hex
    place = f"{checkpoint_folder(spark).rstrip('/')}/corpusgraph/{name}"
    table = f"corpusgraph_{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.format("parquet").option("path", place).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    kept = spark.table(table)
    kept.schema  # resolved now: the files stay when the catalog forgets the table
    spark.sql(f"DROP TABLE {table}")
    return kept


def by_shuffle(frame: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: the join sorts both sides by key and never broadcasts this one.

    The planner takes a table's compressed size for its size in memory, so a side of a few MB on disk would pass
    through the driver as hundreds.
    """
    return frame.hint("merge")


def cut_counting(frame: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, and how many rows it wrote, in all and per condition.

    The counts are observed while the rows are written, so they cost no extra job.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows")] + [F.count_if(c).alias(n) for n, c in conditions.items()]
    kept = cut(frame.observe(seen, *counts))
    return kept, seen.get


class RoundLimit(RuntimeError):
    """A loop did not settle; a partial answer is never returned."""


def distinct_links(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` once each. Multi-edges carry no more reachability."""
    return edges.select("src", "dst").distinct()


def spread_hubs(links: DataFrame, limit: int = HOT_DEGREE) -> tuple[DataFrame, DataFrame | None]:
    """Split the out-edges of hubs over several join keys.

    Returns the links with a ``part`` column and, when some source has more than
    ``limit`` out-edges, a table ``(src, parts)`` of those sources. At most
    ``edges / limit`` sources can be that large, so the table is small.
    """
    hubs = links.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(
        "src", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    hubs, counts = cut_counting(hubs)
    if not counts["rows"]:
        return links.withColumn("part", F.lit(0)), None
    spread = links.join(hubs, "src", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.hash("dst"), F.col("parts")))).drop("parts")
    return spread, hubs


def expand(frontier: DataFrame, links: DataFrame, hubs: DataFrame | None, keep: list[str]) -> DataFrame:
    """One hop from ``id`` over the links; ``keep`` columns travel along."""
    if hubs is None:
        start = frontier.withColumn("part", F.lit(0))
    else:
        parts = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
        start = frontier.join(hubs.withColumnRenamed("src", "id"), "id", "left").withColumn(
            "part", F.explode(parts)).drop("parts")
    start = start.withColumnRenamed("id", "src")
    hopped = start.join(links, ["src", "part"])
    return hopped.select(*keep, F.col("dst").alias("id"))


def closure(seeds: DataFrame, edges: DataFrame, keys: list[str] | None = None,
            max_rounds: int = 100_000, hub_limit: int = HOT_DEGREE) -> DataFrame:
    """Everything reachable from each seed, the seed included, with the hop count.

    ``seeds`` holds ``keys`` and ``id``. Only new pairs enter the next frontier, so a
    round costs its frontier plus one anti join with what is known.
    """
    keys = keys or []
    links, hubs = spread_hubs(cut(distinct_links(edges)), hub_limit)
    if hubs is not None:
        links = cut(links)
    seen = cut(seeds.select(*keys, "id").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for number in range(1, max_rounds + 1):
        reached = expand(frontier.drop("hops"), links, hubs, keys).distinct()
        fresh, counts = cut_counting(
            reached.join(seen, [*keys, "id"], "left_anti").withColumn("hops", F.lit(number)))
        if not counts["rows"]:
            return seen
        seen = seen.unionByName(fresh)
        if number % 16 == 0:
            seen = cut(seen)
        frontier = fresh
    raise RoundLimit(f"closure still growing after {max_rounds} rounds")


def jump_to_end(parents: DataFrame) -> DataFrame:
    """Follow ``(id, parent, ord)`` to the end of each chain by pointer doubling.

    With a ``weight`` column a step to the parent counts that much, else one. Returns ``(id, root, steps, cyclic, on_cycle, low)``: the last node of the chain
    and the hops to it. ``cyclic`` marks chains that never end, ``on_cycle`` those
    whose start lies on the cycle itself, ``low`` is then the smallest ``ord`` of
    that cycle. A chain of n nodes takes about log2(n) rounds. Finished rows leave
    the loop, so a popular root does not draw every row to one join key.
    """
    if "ord" not in parents.columns:
        parents = parents.withColumn("ord", F.col("id"))
    weight = F.col("weight") if "weight" in parents.columns else F.lit(1)
    start, counts = cut_counting(parents.select(
        "id", F.coalesce("parent", "id").alias("jump"), F.when(F.col("parent").isNotNull(), weight).otherwise(0).cast("long").alias("steps"),
        F.col("parent").isNotNull().alias("open"), F.col("ord").alias("low")), open=F.col("open"))
    done, active = start.filter("NOT open"), start.filter("open")
    count, covered, rounds = counts["open"], 1, 0
    while count:
        far = done.unionByName(active).select(
            F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("steps").alias("more"),
            F.col("open").alias("far_open"), F.col("low").alias("far_low"))
        new, counts = cut_counting(active.join(by_shuffle(far), "jump", "left").select(
            "id", F.coalesce("far", "jump").alias("jump"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.coalesce("far_open", F.lit(False)).alias("open"), F.least("low", "far_low").alias("low")),
            open=F.col("open"))
        done = done.unionByName(new.filter("NOT open"))
        active = new.filter("open")
        left = counts["open"]
        covered *= 2
        rounds += 1
        # No chain ended and every cycle was walked round: only cycles are left.
        if left == count and covered >= 2 * left:
            break
        count = left
        if rounds % 16 == 0:
            done = cut(done)
    tails = active.select(F.col("jump").alias("id"), F.lit(True).alias("on_cycle")).distinct()
    ended = done.select("id", F.col("jump").alias("root"), "steps", F.lit(False).alias("cyclic"),
                        F.lit(False).alias("on_cycle"), "low")
    endless = active.join(by_shuffle(tails), "id", "left").select(
        "id", F.col("jump").alias("root"), "steps", F.lit(True).alias("cyclic"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "low")
    return ended.unionByName(endless)


def ancestors(parents: DataFrame) -> DataFrame:
    """``(id, ancestor, hops)`` of acyclic ``(id, parent)`` chains in log2(depth) rounds."""
    pairs, counts = cut_counting(parents.filter("parent IS NOT NULL").select(
        "id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("hops")))
    reach, tip, left = 1, pairs, counts["rows"]
    while left:
        upper = pairs.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("far"), F.col("hops").alias("more"))
        reach *= 2
        fresh, counts = cut_counting(tip.join(upper, "ancestor").select(
            "id", F.col("far").alias("ancestor"), (F.col("hops") + F.col("more")).alias("hops")),
            tip=F.col("hops") == reach)
        pairs = pairs.unionByName(fresh)
        tip, left = fresh.filter(F.col("hops") == reach), counts["tip"]
    return pairs
