"""Tables in the folder all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it. Where none is set, local sessions (tests) get a temporary folder; a cluster raises, as its executors share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keelson-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/keelson-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got.shared_path = path
    return got


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote for these; nothing that is still to run may read them. Other DataFrames are left alone."""
    for df in tables:
        if path := df.__dict__.get("shared_path"):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
