"""Numbering inside groups of any size."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_number(table: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``row_number`` per key, spread over ordered buckets of each key.

    Buckets (days, say) must follow the order. Only their counts are summed per key,
    so one key with a large share of the rows is numbered by many tasks. A null key or
    bucket is a value like others, the bucket before all others.
    """
    rows = table.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = [f"_key{k}" for k in range(len(keys))]
    offsets = counts.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("_bucket").alias("_bucket2"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_place", F.row_number().over(inside))
    same = F.col("_bucket").eqNullSafe(F.col("_bucket2"))
    for key, other in zip(keys, own):
        same = same & F.col(key).eqNullSafe(F.col(other))
    return numbered.join(offsets, same).withColumn(
        name, (F.col("_place") + F.col("_offset")).cast("long")).drop("_bucket", "_bucket2", "_place", "_offset", *own)
