"""Work on what changed only: re-validation and graph refresh per micro-batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusgraph.operators import validation
from corpusgraph.plans.loops import cut
from corpusgraph.streaming.feeds import run_batches, work_folder


def last_version(batch: DataFrame, key: str, value: str, version: str | None) -> DataFrame:
    """``(key, value)`` once per key: the row of the highest ``version``.

    Without a version column a batch has no order, and the greatest value stands; so
    a batch that is run again gives the same rows either way.
    """
    order = F.col(value) if version is None else F.struct(version, value)
    return batch.groupBy(key).agg(F.max_by(value, order).alias(value))


def revalidate(docs: DataFrame, version: str | None = None, place: str | None = None) -> DataFrame:
    """Problems of changed documents, from a stream of ``(scene, doc)`` and perhaps a version column.

    A reader takes, per scene, the problems of its last batch; scenes that became
    clean appear in the ``checked`` part of that batch without a problem. ``place`` keeps the log for the next run.
    """
    spark = docs.sparkSession
    place = place or work_folder(spark, "revalidate")

    def handle(batch: DataFrame, number: int) -> None:
        latest = last_version(batch, "scene", "doc", version)
        problems = validation.document_problems(latest)
        problems.write.mode("overwrite").parquet(f"{place}/problems/batch={number}")
        latest.select("scene").write.mode("overwrite").parquet(f"{place}/checked/batch={number}")

    run_batches(docs, handle, "revalidate", place=place)
    problems = spark.read.schema("scene bigint, path string, message string, batch int").parquet(f"{place}/problems")
    checked = spark.read.schema("scene bigint, batch int").parquet(f"{place}/checked")
    last = checked.groupBy("scene").agg(F.max("batch").alias("batch"))
    return problems.join(last, ["scene", "batch"], "left_semi").select("scene", "path", "message")


# --- edges as an append-only log ---------------------------------------------
# ``edges/batch=n`` holds the edges that batch n found and ``changed/batch=n`` the files that it looked at; batch -1 is
# the table at the start. An edge stands if its batch is the last one that looked at its file. A batch writes
# only what changed, under its number, so a batch that runs again replaces its own rows and nothing else.

def _start(edges: DataFrame, place: str) -> None:
    edges.write.mode("ignore").parquet(f"{place}/edges/batch=-1")
    edges.limit(0).select(F.col("src").alias("path")).write.mode("ignore").parquet(f"{place}/changed/batch=-1")


def current_edges(spark: SparkSession, place: str, schema: StructType) -> DataFrame:
    """The edges that stand in the log at ``place``."""
    log = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{place}/edges")
    changed = spark.read.schema(StructType([StructField("path", schema["src"].dataType), StructField("batch", IntegerType())])).parquet(
        f"{place}/changed")
    last = changed.groupBy(F.col("path").alias("src")).agg(F.max("batch").alias("_last"))
    return log.join(last, "src", "left").filter(F.col("batch") == F.coalesce("_last", F.lit(-1))).select(*schema.names)


def compact_edges(spark: SparkSession, place: str, schema: StructType, to: str) -> None:
    """Begin a new log at ``to`` with the edges that stand at ``place``; replaced rows stay behind."""
    _start(current_edges(spark, place, schema), to)


def refresh_edges(edges: DataFrame, changes: DataFrame, extract, version: str | None = None, place: str | None = None) -> DataFrame:
    """Edge table after a stream of changed files ``(path, content)`` and perhaps a version column.

    Each batch logs its files and the edges that ``extract(files)`` finds now, at the last version of each file in the batch; a
    null content is a file that is gone. ``place`` keeps the log and the progress: ``edges`` start it if it is
    new, and a later run goes on with it.
    """
    spark = edges.sparkSession
    place = place or work_folder(spark, "edges")
    _start(edges, place)

    def handle(batch: DataFrame, number: int) -> None:
        files = cut(last_version(batch, "path", "content", version))
        extract(files.filter("content IS NOT NULL")).select(*edges.columns).write.mode("overwrite").parquet(f"{place}/edges/batch={number}")
        files.select("path").write.mode("overwrite").parquet(f"{place}/changed/batch={number}")

    run_batches(changes, handle, "edges", place=place)
    return current_edges(spark, place, edges.schema)
