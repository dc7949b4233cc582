"""Streams: queues, pipes, drains and formulas over Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import exists, place


def queue(spark: SparkSession, path: str, like: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """A stream of Parquet rows; the availableNow trigger reads it as a closed queue.

    path: a folder or a single file. like: a batch frame with its schema.
    """
    schema = (like if like is not None else spark.read.parquet(path)).schema
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream until its source has no more, and gives what came out, as a table in the shared folder.

    In append mode batches go to a Parquet sink, exactly once. In complete mode a batch is
    the whole result, so each replaces the one before under a path of its own, and the last is read.
    """
    spark = stream.sparkSession
    at = place(spark)
    writer = stream.writeStream.option("checkpointLocation", checkpoint or place(spark)).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").outputMode("append").option("path", at).start()
        _finish(q)
        return spark.read.schema(stream.schema).parquet(at) if exists(spark, at) else spark.createDataFrame([], stream.schema)
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{number}")
        last[:] = [f"{at}/{number}"]

    _finish(writer.outputMode(mode).foreachBatch(keep).start())
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


def _finish(q) -> None:
    try:
        q.awaitTermination()
    finally:
        q.stop()


def sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Appends a stream to Parquet files, exactly once."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def formula(stream: DataFrame, make: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Computes ``make`` anew on every batch of a stream, with what it refers to as it is then; gives what came out."""
    spark, at = stream.sparkSession, place(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{at}/batch={number}")

    _finish(stream.writeStream.option("checkpointLocation", place(spark)).trigger(availableNow=True).foreachBatch(keep).start())
    return spark.read.schema(schema).parquet(*[f"{at}/*"]) if exists(spark, at) else spark.createDataFrame([], schema)


def hoards(df: DataFrame) -> bool:
    """Whether a result has to be collected first (an aggregation, sort or limit), or goes on item by item."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return any(x in plan for x in ("Aggregate", "Sort", "GlobalLimit"))


def detached(jobs: list[Callable[[], object]], threads: int = 4) -> list[Future]:
    """Starts driver-side jobs and goes on; each is an independent Spark job."""
    pool = ThreadPoolExecutor(threads)
    out = [pool.submit(f) for f in jobs]
    pool.shutdown(wait=False)
    return out


def sleep(seconds: float) -> float:
    """Waits on the driver, and gives how long it was."""
    began = time.monotonic()
    time.sleep(seconds)
    return time.monotonic() - began


class Pipes:
    """Named pipeline stages: each is a function of the one before, found by name."""

    def __init__(self):
        self.stages: dict[str, Callable[[], DataFrame]] = {}

    def define(self, name: str, make: Callable[..., DataFrame], *sources: str) -> Pipes:
        if name in self.stages:
            raise ValueError(f"{name} is a pipe already")
        self.stages[name] = lambda: make(*[self.stages[s]() for s in sources])
        return self

    def __getitem__(self, name: str) -> DataFrame:
        """The stage's frame, made anew: a formula is evaluated at each read."""
        return self.stages[name]()


def unique(stream: DataFrame, key: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """A set over an open source; with a time column, state older than the watermark is let go."""
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def increments(stream: DataFrame, key: list[str], value: Column) -> DataFrame:
    """Running counters by key."""
    return stream.groupBy(*key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, every: str, by: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by tumbling window, or with ``slide`` by sliding ones; rows later than ``late`` behind the newest are left out once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every, slide or every), *by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by session: runs of rows of one key with no gap longer than ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def threaded(jobs: list[Callable[[], object]], threads: int = 4) -> list[object]:
    """Runs driver-side jobs side by side; each is an independent Spark job."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda f: f(), jobs))
