"""An external store that is spoken to by messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import exists


class Store:
    """Tables under one path of any file system that Spark reaches. ``send`` dispatches a message to what handles it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._open = spark, path.rstrip("/"), False
        self.messages: dict[str, Callable] = {"open": self.open, "close": self.close, "is-open": lambda: self._open, "write": self.write, "read": self.read, "delete": self.delete}

    def send(self, message: str, *args: object) -> object:
        if message not in self.messages:
            raise ValueError(f"the store has no message {message}; it has {', '.join(sorted(self.messages))}")
        return self.messages[message](*args)

    def open(self) -> Store:
        self._open = True
        return self

    def close(self) -> None:
        self._open = False

    def _at(self, name: str) -> str:
        if not self._open:
            raise RuntimeError("the store isn't open")
        return f"{self.path}/{name}"

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._at(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def delete(self, name: str) -> bool:
        at = self._at(name)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return exists(self.spark, at) and path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
