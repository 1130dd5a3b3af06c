"""Running sums over dense positions."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, rows_in_all: int, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows up to this one, by ``position`` (0 to ``rows_in_all - 1``, each once).

    Positions are cut into about as many pieces as a piece has rows. Pieces are summed, the sums of the
    pieces before are added up in one small window, then each piece runs alone.
    """
    size = math.isqrt(max(rows_in_all, 1)) + 1
    cut_up = rows.withColumn("_piece", F.expr(f"position div {size}"))
    sums = cut_up.groupBy("_piece").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_piece").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return cut_up.withColumn("_inside", F.sum(value).over(inside)).join(offsets, "_piece").withColumn(
        name, F.col("_inside") + F.col("_before")).drop("_piece", "_inside", "_before")
