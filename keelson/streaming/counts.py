"""Micro-batch counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.plans.lineage import fresh_path


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int = 1, pattern: str | None = None) -> DataFrame:
    """New files of a folder, a few a batch; stands in for an event server."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def drain(stream: DataFrame, path: str) -> None:
    """All that has arrived by now, each row once, to path; the files of a batch that runs again are not read twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(stream.sparkSession, "stream")).trigger(availableNow=True).start().awaitTermination()


def batch_counts(stream: DataFrame, key: str, path: str) -> None:
    """Counts of each micro-batch by itself, appended to path as (batch_id, key, cnt); stateless. A batch run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("cnt")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    spark = stream.sparkSession
    stream.writeStream.foreachBatch(write).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()


def running_counts(stream: DataFrame, key: str, path: str) -> None:
    """Counts over all batches so far, kept as state; each batch writes the keys that changed, as (batch_id, key, cnt)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    counts = stream.groupBy(key).agg(F.count("*").alias("cnt"))
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", fresh_path(stream.sparkSession, "stream")).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last count that running_counts wrote of each key."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by("cnt", "batch_id").alias("cnt"))
