"""Positions and running sums over whole tables, without one task for all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.plans.loops import cut


def ranged(table: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The table cut into ranges of ``order``; ``_part`` numbers the ranges. Rows that tie share a range."""
    parts = partitions or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(table.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def with_running_sum(table: DataFrame, order: list[Column], value: Column, name: str, ties: list[Column] | None = None,
                     partitions: int | None = None) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before this one, in ``order`` and then ``ties``.

    Ranges are summed first; only their sums, one row per range, are added up in one
    place. Full ties follow one another in some order.
    """
    rows = ranged(table.withColumn("_value", value), order, partitions)
    sums = rows.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(offsets, "_part").withColumn(
        name, F.col("_inside") + F.col("_offset")).drop("_value", "_part", "_inside", "_offset")
