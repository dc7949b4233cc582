"""Document fingerprints from closed syncmers.

A window of ``K`` bytes is an anchor when the smallest hash among its ``S``-byte substrings
lies at either end. Whether it is depends on the window's own bytes alone, so a passage
keeps its anchors wherever it stands. A fingerprint holds the ``SIZE`` anchors with the
smallest hashes and where each first stands; two fingerprints are alike by the share of
those anchors that both hold at a consistent shift.
"""

from __future__ import annotations

import base64
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .textops import CHUNK_BYTES, Run, mix64, runs

K = 20
S = 8
SIZE = 64
#: Positions are kept in units of so many bytes.
UNIT = 16
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Text bytes of a range of ids, the most ranges there may be, and the rows sampled for each bound.
RANGE_BYTES = 64 << 20
MOST_RANGES = 16_384
BOUND_ROWS = 16


def anchors(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed syncmers of each text: text number, hash, byte offset in the text.

    A text shorter than ``K`` bytes is one anchor of its own; an empty one has none.
    """
    size = np.diff(run.offs)
    short = np.flatnonzero((size > 0) & (size < K))
    n = len(run.buf) - K + 1
    at = np.zeros(0, np.int64)
    if n > 0:
        v = run.buf.astype(np.uint64)
        for step in (1, 2, 4):
            v = v[:-step] | (v[step:] << np.uint64(8 * step))
        v = mix64(v)
        w = K - S + 1
        low, have = v, 1
        while have < w:
            step = min(have, w - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        mark = (v[:n] == low[:n]) | (v[w - 1 : w - 1 + n] == low[:n])
        at = np.flatnonzero(mark)
        who = np.searchsorted(run.offs, at, "right") - 1
        inside = at + K <= run.offs[who + 1]
        at, who = at[inside], who[inside]
    else:
        who = at
    starts = np.concatenate([at, run.offs[short]])
    ends = np.concatenate([at + K, run.offs[short + 1]])
    who = np.concatenate([who, short])
    return who, run.hash(starts, ends), starts - run.offs[who]


@dataclass
class Prints:
    """Fingerprints, a row each: up to ``SIZE`` hashes, ascending (EMPTY beyond the last), and their positions."""

    hash: np.ndarray
    pos: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def __getitem__(self, rows: slice | np.ndarray) -> Prints:
        return Prints(self.hash[rows], self.pos[rows])

    @staticmethod
    def join(parts: list[Prints]) -> Prints:
        return Prints(np.concatenate([np.zeros((0, SIZE), np.uint64), *[p.hash for p in parts]]), np.concatenate([np.zeros((0, SIZE), np.int64), *[p.pos for p in parts]]))

    def printed(self) -> list[str]:
        """As text: eight bytes of hash and four of position, big-endian, for each anchor."""
        raw = np.empty((*self.hash.shape, 12), np.uint8)
        raw[..., :8] = self.hash.astype(">u8")[..., None].view(np.uint8)
        raw[..., 8:] = np.minimum(self.pos, 0xFFFFFFFF).astype(">u4")[..., None].view(np.uint8)
        n = (self.hash != EMPTY).sum(1)
        return [base64.b64encode(raw[i, : n[i]].tobytes()).decode() for i in range(len(raw))]


def least(who: np.ndarray, h: np.ndarray, pos: np.ndarray, n: int) -> Prints:
    """The ``SIZE`` smallest distinct hashes of each of ``n`` texts, each where it first stands."""
    h = np.minimum(h, EMPTY - np.uint64(1))
    order = np.lexsort((pos, h, who))
    who, h, pos = who[order], h[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    who, h, pos = who[new], h[new], pos[new]
    rank = np.arange(len(who)) - np.searchsorted(who, np.arange(n + 1))[who]
    keep = rank < SIZE
    out = Prints(np.full((n, SIZE), EMPTY), np.zeros((n, SIZE), np.int64))
    out.hash[who[keep], rank[keep]] = h[keep]
    out.pos[who[keep], rank[keep]] = pos[keep] // UNIT
    return out


def fingerprints(run: Run) -> Prints:
    """One row a text. A text much longer than a run is taken in pieces that overlap by a window."""
    if len(run) > 1 or len(run.buf) <= 2 * CHUNK_BYTES:
        return least(*anchors(run), len(run))
    best = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(run.buf) - K + 1, CHUNK_BYTES):
        piece = run.buf[i : i + CHUNK_BYTES + K - 1]
        _, h, pos = anchors(Run(piece, np.array([0, len(piece)])))
        h, pos = np.concatenate([best[0], h]), np.concatenate([best[1], pos + i])
        order = np.lexsort((pos, h))
        h, pos = h[order], pos[order]
        new = np.append(True, h[1:] != h[:-1])
        best = h[new][:SIZE], pos[new][:SIZE]
    return least(np.zeros(len(best[0]), np.int64), *best, 1)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Row by row: of the ``SIZE`` smallest hashes that either holds, the share that both hold at a consistent shift.

    A shift is b's position less a's. Shifts count as consistent within an eighth of the
    longer span around their median. Two empty fingerprints are alike by 1, an empty and
    another one by 0.
    """
    h, pos = np.concatenate([a.hash, b.hash], 1), np.concatenate([a.pos, b.pos], 1)
    order = np.argsort(h, 1, kind="stable")  # of equal hashes a's comes first
    h, pos = np.take_along_axis(h, order, 1), np.take_along_axis(pos, order, 1)
    real = h != EMPTY
    dup = np.zeros(h.shape, bool)
    dup[:, 1:] = (h[:, 1:] == h[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~dup, 1)
    union = np.minimum(rank[:, -1], SIZE)
    both = dup & (rank <= SIZE)
    shift = np.zeros(h.shape, np.int64)
    shift[:, 1:] = pos[:, 1:] - pos[:, :-1]
    n = both.sum(1)
    far = np.sort(np.where(both, shift, np.iinfo(np.int64).max), 1)
    mid = np.where(n > 0, far[np.arange(len(h)), np.maximum((n - 1) // 2, 0)], 0)
    span = np.where(real, pos, 0).max(1, initial=0)
    near = both & (np.abs(shift - mid[:, None]) <= (2 + span // 8)[:, None])
    return np.where(union > 0, near.sum(1) / np.maximum(union, 1), 1.0)


def run_of(texts: list[bytes]) -> Run:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return Run(np.frombuffer(b"".join(texts), np.uint8), offs)


def all_fingerprints(texts: list[bytes]) -> Prints:
    out, i = [], 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK_BYTES):
            n += len(texts[j])
            j += 1
        out.append(fingerprints(run_of(texts[i:j])))
        i = j
    return Prints.join(out)


def after(text: bytes, n: int) -> int:
    """Bytes that the first ``n`` code points of ``text`` take up, at most all."""
    if n <= 0:
        return 0
    if n >= len(text) or text.isascii():
        return min(n, len(text)) if text.isascii() else len(text)
    leads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return int(leads[n]) if n < len(leads) else len(text)


def edited(text: bytes, n_chars: int, following: bytes) -> bytes:
    """``text`` (of ``n_chars`` code points) with its last half replaced by as many code points from the start of ``following``."""
    half = n_chars // 2
    return text[: after(text, n_chars - half)] + following[: after(following, half)]


def bounds_of(keyed: DataFrame, rows: int, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``n_parts`` - 1 keys (ranked id, text hash), ascending, that cut the ``rows`` of ``keyed`` into parts of about equal size."""
    # drawn row by row: a key that many rows share must not come in whole
    drawn = keyed.where(F.rand(11) < min(1.0, BOUND_ROWS * n_parts / max(rows, 1))).select("_a", "_h").toArrow()
    a, h = (drawn.column(c).to_numpy() for c in ("_a", "_h"))
    order = np.lexsort((h, a))
    at = order[np.unique(np.linspace(0, len(order), n_parts + 1).astype(np.int64)[1:-1])] if len(order) else order
    cut = np.unique(np.stack([a[at], h[at]], 1), axis=0)
    return cut[:, 0], cut[:, 1]


def part_of(a: np.ndarray, h: np.ndarray, cut_a: np.ndarray, cut_h: np.ndarray) -> np.ndarray:
    """The number of cuts that a key isn't below."""
    low, high = np.searchsorted(cut_a, a, "left"), np.searchsorted(cut_a, a, "right")
    out = low.copy()
    several = np.flatnonzero(high > low)
    for x in np.unique(a[several]):
        mine = several[a[several] == x]
        i, j = low[mine[0]], high[mine[0]]
        out[mine] = i + np.searchsorted(cut_h[i:j], h[mine], "right")
    return out


def with_next(docs: DataFrame, rows: int, n_parts: int) -> DataFrame:
    """The ``rows`` of ``docs`` dealt by ranges of their order, and each range ends with a copy
    (halo) of the row that follows it, so that every row's successor is in its own task.

    The order is doc_id descending, null ids last, then a hash of the text, so that rows of
    one id (or none) still fall into several ranges; rows alike in both are alike for all
    that is made of them. Only sampled keys and each range's first key reach the driver.
    """
    spark = docs.sparkSession
    none = F.col("doc_id").isNull()
    keyed = docs.select("doc_id", "text", F.when(none, (1 << 63) - 1).otherwise(F.bitwise_not(F.col("doc_id").cast("long"))).alias("_a"), none.cast("int").alias("_null"), F.xxhash64("text").alias("_h"))
    shipped = spark.sparkContext.broadcast(bounds_of(keyed, rows, n_parts))

    @F.arrow_udf("int")
    def dealt(a: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(part_of(a.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False), *shipped.value), pa.int32())

    placed = keyed.withColumn("part", dealt("_a", "_h"))
    first = placed.groupBy("part").agg(F.min(F.struct("_a", "_null", "_h")).alias("k")).orderBy("part").collect()
    # the first row of a range also ends the range before; that of the first one ends the last
    ends = spark.createDataFrame([(*r["k"], first[i - 1]["part"]) for i, r in enumerate(first)], "_a long, _null int, _h long, _to int")
    placed = placed.join(F.broadcast(ends), ["_a", "_null", "_h"], "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"))
    copies = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("part"), F.lit(True).alias("halo"))))
    out = placed.select("doc_id", "text", "_a", "_null", "_h", F.explode(copies).alias("_at")).select("doc_id", "text", "_at.*", "_a", "_null", "_h")
    return out.repartitionById(n_parts, "part").sortWithinPartitions("part", "halo", "_a", "_null", "_h")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited form (see ``edited``), and their likeness.

    Null texts count as empty. Rows of one id follow each other by a hash of their text,
    null ids come last; repeated rows follow each other. Texts of any length are taken whole.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batches):
        held: tuple | None = None  # the row before, whose successor comes now: id, text, code points, part, fingerprint
        for batch in batches:
            ids, part, halo = (batch.column(c).to_pylist() for c in ("doc_id", "part", "halo"))
            for run in runs(batch.column("text")):
                own, chars = fingerprints(run), run.code_points()
                done, changed, nxt = [], [], []
                for k in range(len(run)):
                    i, text = run.first + k, run.text(k)
                    if held is not None and held[3] == part[i]:
                        done.append(held)
                        changed.append(edited(held[1], held[2], text))
                        nxt.append(own[k : k + 1])
                        held = None
                    if not halo[i]:
                        held = (ids[i], text, int(chars[k]), part[i], own[k : k + 1])
                if done:
                    mine, other = Prints.join([d[4] for d in done]), all_fingerprints(changed)
                    columns = [
                        pa.array([d[0] for d in done], pa.int64()),
                        pa.array([d[2] for d in done], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in changed]),
                        pa.array(mine.printed()),
                        pa.array(other.printed()),
                        pa.array(likeness(mine, other)),
                        pa.array(likeness(mine, Prints.join(nxt))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(2 * cluster.parts(docs.sparkSession), math.ceil(size / RANGE_BYTES)))
    return with_next(docs.select("doc_id", "text"), n, ranges).mapInArrow(cluster.frugal(work), SCHEMA)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(cluster.table(spark, sf_dir, "documents"))
