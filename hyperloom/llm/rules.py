"""Quality rules: fixed heuristics, then a hashed n-gram log-likelihood ratio.

The n-grams are the text's windows of ``GRAM`` bytes, hashed to ``BUCKETS`` counters. The
raw multinomial counts every window of every document; the trusted one counts those of a
bounded sample of rows labelled as good. A text's score is its mean log ratio a window,
so length doesn't enter, and one constant threshold decides for every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .textops import Run, owner, runs, shingles

GRAM = 4
BUCKETS = 1 << 18
#: At most about so many trusted rows are counted.
TRUSTED_ROWS = 20_000
#: Windows added on either side of a ratio.
SMOOTHING = 2.0
THRESHOLD = -0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def grams(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte window, and n + 1 offsets by text; a shorter text has none."""
    size = np.maximum(np.diff(run.offs) - GRAM + 1, 0)
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    n = len(run.buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros_like(out)
    b = run.buf.astype(np.uint32)
    v = b[:n].copy()
    for j in range(1, GRAM):
        v <<= np.uint32(8)
        v |= b[j : n + j]
    v *= np.uint32(0x9E3779B1)
    v >>= np.uint32(32 - (BUCKETS.bit_length() - 1))
    whole = np.ones(n, bool)
    for e in run.offs[1:-1]:  # windows that cross into the next text
        whole[max(0, e - GRAM + 1) : e] = False
    return v[whole], out


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def repeated(h: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: Run) -> np.ndarray:
    """Words of each text that lie in a window of 5 words found twice or more in it."""
    n = np.diff(offs)
    grams_, at = shingles(h, np.asarray(offs), WINDOW)
    who = owner(at)
    full = (n >= WINDOW)[who]
    first = np.repeat(offs[:-1] - at[:-1], np.diff(at)) + np.arange(len(who))
    g, who, first = grams_[full], who[full], first[full]
    key = g + who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(key), bool)
    pair = np.flatnonzero(same)
    if len(pair):
        a, b = first[order[pair]], first[order[pair + 1]]
        alike = who[order[pair]] == who[order[pair + 1]]
        for j in range(WINDOW):  # the words themselves, by their own hashes
            alike &= h[a + j] == h[b + j]
        twice[order[pair[alike]]] = True
        twice[order[pair[alike] + 1]] = True
    mark = np.zeros(len(h) + 1, np.int64)
    for j in range(WINDOW):
        mark[first[twice] + j] = 1
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(mark[:-1], out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def statistics(run: Run) -> list[np.ndarray]:
    starts, ends, offs = run.words()
    lead = np.zeros(len(run.buf) + 1, np.int64)
    np.cumsum((run.buf & 0xC0) != 0x80, out=lead[1:])
    chars = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lead[ends] - lead[starts], out=chars[1:])
    h = run.hash(starts, ends)
    ls, le, lo = run.lines()
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    who = owner(lo)[full]
    key = run.hash(ls[full], le[full]) + who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, at = np.unique(key, return_index=True)
    dup = np.bincount(who, minlength=len(run)) - np.bincount(who[at], minlength=len(run))
    return [np.diff(offs), chars[offs[1:]] - chars[offs[:-1]], run.per_text(_SYMBOL[run.buf]), dup, repeated(h, offs, starts, ends, run)]


def log_ratio(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray | None:
    """log(trusted share / raw share) by bucket, from one pass over all of ``docs``."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    n = good.count()
    if not n:
        return None
    picked = good.where(cluster.chance(F.col("doc_id")) < min(1.0, trusted_rows / n)).distinct().withColumn("_good", F.lit(True))
    rows = docs.select("doc_id", "text").join(cluster.small(picked), "doc_id", "left").select(F.col("_good").isNotNull().alias("good"), "text")

    def count(batches):
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for run in runs(batch.column("text")):
                v, offs = grams(run)
                raw += np.bincount(v, minlength=BUCKETS)
                mine = good[run.first : run.first + len(run)]
                if mine.any():
                    trusted += np.bincount(v[np.repeat(mine, np.diff(offs))], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "raw", "trusted"])

    got = rows.mapInArrow(cluster.frugal(count), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"]] = got["raw"]
    trusted[got["bucket"]] = got["trusted"]
    if not trusted.sum():
        return None
    # trusted windows against those that the raw shares let expect: few of either say little
    return np.log((trusted + SMOOTHING) / (trusted.sum() * raw / max(raw.sum(), 1) + SMOOTHING)).astype(np.float32)


def judge(docs: DataFrame, weights: np.ndarray | None, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the text's statistics, llr, base_failed and kept.

    A null or empty text has no words and fails the base rules; a text shorter than a
    window has llr 0. Without trusted rows the llr is 0 and the base rules alone decide.
    Long texts are read whole; repeated rows are judged alike.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = docs.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("llr", "double")

    def measure(batches):
        for batch in batches:
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names] + [[np.zeros(0)]]
            for run in runs(cluster.texts_of(batch)):
                for c, x in zip(cols, statistics(run), strict=False):
                    c.append(x.astype(np.int64))
                if shipped.value is None:
                    cols[-1].append(np.zeros(len(run)))
                else:
                    v, offs = grams(run)
                    cols[-1].append(sums(shipped.value[v], offs) / np.maximum(np.diff(offs), 1))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(np.concatenate(c)) for c in cols], names=[*keep, *names, "llr"])

    out = cluster.kept_and_text(docs, keep).mapInArrow(cluster.frugal(measure), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cluster.table(spark, sf_dir, "documents")
    weights = log_ratio(docs, cluster.table(spark, sf_dir, "labels"))
    out = judge(docs, weights, ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
