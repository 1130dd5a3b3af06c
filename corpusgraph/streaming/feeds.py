"""Change feeds and sinks for Structured Streaming."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corpusgraph.session import checkpoint_folder


def change_feed(spark: SparkSession, folder: str, schema: StructType | str, pattern: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Rows of new parquet files in a folder, with a declared schema."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/corpusgraph/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, append it to a table, and return that table."""
    spark = stream.sparkSession
    place = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str, mode: str = "append",
                place: str | None = None) -> None:
    """Process what is there, one call per micro-batch.

    With ``place`` the progress is kept there, so a later run goes on where this one ended, and a batch
    that was cut off is handed over again under its number.
    """
    place = place or work_folder(stream.sparkSession, name)
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
