"""Requests and patch blocks found in replies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import text as T


def missing_requests(replies: DataFrame, files: DataFrame) -> DataFrame:
    """Path-like requests that name no known file."""
    asked = replies.select("reply_id", F.explode(T.context_requests(F.col("reply"))).alias("item"))
    return asked.filter(T.looks_like_path(F.col("item"))).join(
        files.select(F.col("path").alias("item")), "item", "left_anti"
    )


def requested_files(issues: DataFrame) -> DataFrame:
    """Files named by a log or asked for, once each, by first position."""
    named = issues.select("query_id", F.explode(T.file_references(F.col("logs"))).alias("r")).select(
        "query_id", F.col("r.file").alias("file"), F.col("r.ord").alias("seq"))
    asked = issues.select(
        "query_id", F.explode(T.attachment_requests(F.col("logs"))).alias("file")
    ).withColumn("seq", F.lit(1_000_000))
    return named.unionByName(asked).groupBy("query_id", "file").agg(F.min("seq").alias("seq"))


def file_block_rows(replies: DataFrame) -> DataFrame:
    rows = replies.select("reply_id", F.posexplode(T.file_blocks(F.col("reply"))).alias("i", "b"))
    return rows.select("reply_id", (F.col("i") + 1).alias("block_no"), "b.path", "b.content")


def edit_block_rows(replies: DataFrame) -> DataFrame:
    rows = replies.select("reply_id", F.posexplode(T.edit_blocks(F.col("reply"))).alias("i", "b"))
    return rows.select("reply_id", (F.col("i") + 1).alias("block_no"), "b.path", "b.find", "b.replace")
