"""Reachability from many seeds at once, 64 of them in each long."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.dense import dictionary
from corpusgraph.plans.loops import HOT_DEGREE, RoundLimit, cut, cut_counting, distinct_links, expand, spread_hubs

WORD = 64
#: Rounds after which what is known is written as one table.
COMPACT = 8


def reach_words(seeds: DataFrame, links: DataFrame, max_rounds: int = 100_000, hub_limit: int = HOT_DEGREE) -> tuple[DataFrame, DataFrame]:
    """``(id, word, bits)``: which seeds reach a node, and ``(seed, place)``: bit ``place % 64`` of word ``place div 64``.

    Seeds are numbered in order of their ids, so seeds of one project share words. A round sends the bits that
    are new at a node over its links, ORs them per target and word before the shuffle, and keeps what the target did not
    have: at most nodes times words rows.
    """
    links, hubs = spread_hubs(cut(distinct_links(links)), hub_limit)
    links = cut(links) if hubs is not None else links
    known = cut(dictionary(seeds.select(F.col("id").alias("seed")), "place"))
    bit = F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")
    start = cut(known.select(F.col("seed").alias("id"), F.expr(f"place div {WORD}").alias("word"), bit.alias("bits")))
    seen, frontier = start, start
    for number in range(1, max_rounds + 1):
        reached = expand(frontier, links, hubs, ["word", "bits"]).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
        had = seen.groupBy("id", "word").agg(F.bit_or("bits").alias("had"))
        fresh = reached.join(had, ["id", "word"], "left").select(
            "id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0")
        fresh, counts = cut_counting(fresh)
        if not counts["rows"]:
            return seen.groupBy("id", "word").agg(F.bit_or("bits").alias("bits")), known
        seen = seen.unionByName(fresh)
        if number % COMPACT == 0:
            seen = cut(seen.groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))
        frontier = fresh
    raise RoundLimit(f"reachability still growing after {max_rounds} rounds")


def reach_pairs(seeds: DataFrame, links: DataFrame, **limits) -> DataFrame:
    """``(seed, id)``: everything reachable from each seed, itself included."""
    words, known = reach_words(seeds, links, **limits)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("bits", k) == 1)
    pairs = words.select("id", "word", F.explode(places).alias("bit")).withColumn("place", F.col("word") * WORD + F.col("bit"))
    return pairs.join(known, "place").select("seed", "id")
