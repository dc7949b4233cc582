"""The folder that the driver and all executors share: tables that cut a lineage lie there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, the checkpoint folder that the context has, or a temporary one in
    local mode (as in tests); on a cluster an unset folder is an error, as a machine's own
    folder would lose rows without a word.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    if not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="hyperloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return os.path.join(shared_dir(spark), f"hyperloom-{spark.sparkContext.applicationId}")


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return os.path.join(own_dir(spark), uuid.uuid4().hex)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet (in folders by a column, if named) and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = place(spark)
    writer = df.write.option("compression", "zstd")
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder. Results that read it end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
