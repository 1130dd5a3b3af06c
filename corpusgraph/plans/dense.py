"""Long numbers for names, so that loops carry no strings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.loops import by_shuffle, cut

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below


def placed(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows``, written, with their places from 0 on in ``order``; full ties follow one another in some order.

    Rows are cut into ranges and numbered inside each; the sizes of the ranges, one per
    partition, are added up on the driver and stand in the plan as one array. So no task
    takes more than a range, whatever the keys.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL_BITS).cast("int")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offsets = F.array(*[F.lit(x).cast("long") for x in before]) if before else F.array(F.lit(0).cast("long"))
    return ranged.withColumn(name, F.get(offsets, part) + F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))).drop("_at")


def dictionary(names: DataFrame, node: str = "node") -> DataFrame:
    """The distinct rows of ``names`` with ``node``: their places from 0 on, in order of the columns."""
    distinct = cut(names.distinct())  # finding the ranges reads the rows once more
    return placed(distinct, [F.col(f"`{c}`") for c in names.columns], node)


class Names:
    """The ids of a graph, per project where ``keys`` names one, and their numbers."""

    def __init__(self, keys: list[str], *ids: DataFrame):
        self.keys = keys
        known = None
        for frame in ids:
            rows = frame.select(*keys, F.col(frame.columns[-1]).alias("id")).filter("id IS NOT NULL")
            known = rows if known is None else known.unionByName(rows)
        self.table = cut(dictionary(known.select(*keys, "id")))

    def number(self, frame: DataFrame, *columns: str) -> DataFrame:
        """``frame`` without project and with numbers instead of the ids in ``columns``; rows with a null there go."""
        for column in columns:
            known = self.table.select(*self.keys, F.col("id").alias(column), F.col("node").alias("_node"))
            frame = frame.join(by_shuffle(known), [*self.keys, column]).drop(column).withColumnRenamed("_node", column)
        return frame.drop(*self.keys)

    def name(self, frame: DataFrame, first: str, *others: str) -> DataFrame:
        """``frame`` with its project and with ids instead of the numbers in the named columns."""
        known = self.table.select(F.col("node").alias(first), F.col("id").alias("_id"), *self.keys)
        frame = frame.join(by_shuffle(known), first).drop(first).withColumnRenamed("_id", first)
        for column in others:
            known = self.table.select(F.col("node").alias(column), F.col("id").alias("_id"))
            frame = frame.join(by_shuffle(known), column).drop(column).withColumnRenamed("_id", column)
        return frame


