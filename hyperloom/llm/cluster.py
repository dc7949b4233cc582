"""What the operators share: folds, bounded samples, and tables in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import release as release
from ..shared import written


#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets its own.
BATCH_BYTES = 4 << 20
#: The most that is broadcast by hint.
BROADCAST_BYTES = 64 << 20


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back: its lineage ends there."""
    return written(df)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def modest_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as rows may be long texts, where the session doesn't."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hand_back() -> None:
    """Gives memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, whose tasks hand back what they freed: a worker waits for its next task, and would hold it meanwhile."""

    def run(batches):
        yield from work(batches)
        hand_back()

    return run


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` with a hint to broadcast it if its rows, counted, stay under the bound; beyond, the optimizer joins as it would."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() * row_bytes <= BROADCAST_BYTES else df


def as_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as one column, _row: it passes through an operator whole, and its text isn't sent twice."""
    return docs.select(F.struct("*").alias("_row"))


def from_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("_row")[c].alias(c) for c in names])


def kept_and_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and _text unless the text travels in _row."""
    return docs.select(*keep) if "_row" in keep else docs.select(*keep, F.col("text").alias("_text"))


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("_text") if "_text" in batch.schema.names else pc.struct_field(batch.column("_row"), "text")


def fold(key: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest``; a null key is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == rest, F.lit(False))


def chance(key: Column) -> Column:
    """A number in [0, 1) that depends on the key's value alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 11) / F.lit(float(1 << 53))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seen: Column) -> list[tuple[str, int]]:
    """About ``per_class`` (text, label) rows of each label value, from rows where ``seen`` holds.

    The sample of ``labels`` is drawn by a hash of its key, so it doesn't depend on the
    partitioning, and has a bounded expected size; only then are texts looked up. An id
    that is marked more than once has the larger of its labels. Of the rows that share an
    id one text counts, the least by hash, so repeated rows don't grow the sample.
    """
    marked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & seen)
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return []
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, per_class / c))) for y, c in n.items()])
    picked = marked.where(chance(F.col("doc_id")) < share)
    rows = docs.select("doc_id", "text").join(small(picked), "doc_id").where(F.col("text").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r")).select("r.*")
    return sorted((r["text"], r["y"]) for r in rows.collect())
