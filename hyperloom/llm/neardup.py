"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal sets of word 5-shingles form a class. Classes that share a band of
MinHash values are linked into candidate families; within a family pairs compare their
MinHash values a few at a time and are dropped as soon as the posterior probability of
reaching the threshold (uniform prior, binomial evidence) falls below a tolerance; the
rest are verified exactly on the shingle sets. A large family is dealt out in pairs of
blocks, or where that sends fewer rows in its bands, so no task holds it whole, and only
link counts and spanning links leave a task: no pair is ever a row.
"""

from __future__ import annotations

from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .components import components
from .textops import Run, mix64, runs, shingles

K = 5
THRESHOLD = 0.8
ROWS_A_BAND, BANDS = 5, 28
HASHES = ROWS_A_BAND * BANDS
#: MinHash values compared in each round of pruning.
ROUND = 20
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-6
#: A family is dealt out in blocks of about so many classes, or shingles in all.
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
BUFFER_BYTES = 1 << 22
#: Pairs held at once while pruning.
PAIRS = 1 << 18

_RNG = np.random.default_rng(20240601)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)


def shingle_sets(run: Run, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and n + 1 offsets by text."""
    starts, ends, offs = run.words()
    h, at = shingles(run.hash(starts, ends), offs, k)
    who = np.repeat(np.arange(len(run)), np.diff(at))
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[new], who[new]
    return h, np.searchsorted(who, np.arange(len(run) + 1))


def minhashes(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash values by text; a text without shingles has the largest value throughout."""
    out = np.full((len(offs) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        x = (h >> np.uint64(32)).astype(np.uint32)
        for i in range(HASHES):
            out[full, i] = np.minimum.reduceat(x * _A[i] + _B[i], offs[full])
    return out


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By values compared: the least number of matches with which a pair stays.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and
    P(J >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(ROUND, HASHES + 1, ROUND):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def survivors(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, need: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left with right, or within left) that pruning keeps."""
    kept_i, kept_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    other = left if right is None else right
    step = max(1, PAIRS // max(len(other), 1))
    for a in range(0, len(left), step):
        rows = np.arange(a, min(a + step, len(left)))
        i, j = np.repeat(rows, len(other)), np.tile(np.arange(len(other)), len(rows))
        if right is None:
            ok = i < j
            i, j = i[ok], j[ok]
        i, j = left[i], other[j]
        ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[ok], j[ok]
        same = np.zeros(len(i), np.int64)
        for n, least in need.items():
            if not len(i):
                break
            same += (sig[i, n - ROUND : n] == sig[j, n - ROUND : n]).sum(1)
            ok = same >= least
            i, j, same = i[ok], j[ok], same[ok]
        kept_i.append(i)
        kept_j.append(j)
    return np.concatenate(kept_i), np.concatenate(kept_j)


def verify(h: np.ndarray, offs: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's exact Jaccard similarity reaches the threshold."""
    size = np.diff(offs)
    inter = np.zeros(len(i), np.int64)
    rows = np.unique(np.concatenate([i, j]))
    if len(i) > 4 * len(rows):
        at = np.concatenate([np.arange(offs[r], offs[r + 1]) for r in rows])
        known, col = np.unique(h[at], return_inverse=True)
        row = np.repeat(np.arange(len(rows)), size[rows])
        a, b = np.searchsorted(rows, i), np.searchsorted(rows, j)
        wide = max(1, (1 << 25) // (4 * len(rows)))
        total = np.zeros((len(rows), len(rows)), np.float32)
        for c in range(0, len(known), wide):
            mine = (col >= c) & (col < c + wide)
            x = np.zeros((len(rows), min(wide, len(known) - c)), np.float32)
            x[row[mine], col[mine] - c] = 1
            total += x @ x.T
        inter = np.rint(total[a, b]).astype(np.int64)
    else:
        for n, (p, q) in enumerate(zip(i, j, strict=True)):
            inter[n] = len(np.intersect1d(h[offs[p] : offs[p + 1]], h[offs[q] : offs[q + 1]], assume_unique=True))
    union = size[i] + size[j] - inter
    return inter >= threshold * union - 1e-9


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def linked(keys: list[tuple], nodes: list[int], blocks: list[int], texts: list[bytes], bands: list[list[int] | None], threshold: float, need: dict[int, int]) -> list[tuple[int, int, int]]:
    """(node, links, least node it is connected with) within each group of equal keys (family or band, block, block).

    Rows with bands (ascending) are dealt by band: a pair counts in the least band that both have.
    """
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    h, at = shingle_sets(Run(np.frombuffer(b"".join(texts), np.uint8), offs))
    sig, size = minhashes(h, at), np.diff(at)
    out = []
    for key, group in groupby(range(len(keys)), keys.__getitem__):
        idx = np.array(sorted(group, key=nodes.__getitem__))
        ids = np.array([nodes[k] for k in idx])
        side = np.array([blocks[k] for k in idx])
        if key[1] == key[2]:
            i, j = survivors(sig, size, idx, None, threshold, need)
        else:
            i, j = survivors(sig, size, idx[side == key[1]], idx[side == key[2]], threshold, need)
        if not len(i):
            continue
        ok = verify(h, at, i, j, threshold)
        i, j = i[ok], j[ok]
        if bands[idx[0]] is not None:
            own = {k: frozenset(bands[k]) for k in idx.tolist()}
            ok = np.array([min(own[p] & own[q]) == key[0] for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
            i, j = i[ok], j[ok]
        place = np.full(len(texts), -1)
        place[idx] = np.arange(len(idx))
        i, j = place[i], place[j]
        n = np.bincount(i, minlength=len(idx)) + np.bincount(j, minlength=len(idx))
        root = local_roots(len(idx), i, j)
        out += [(int(ids[k]), int(n[k]), int(ids[root[k]])) for k in np.flatnonzero(n)]
    return out


SIGNED = "doc_id long, t long, h1 long, h2 long, n_shingles long, bands array<long>"


def signed(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's text hash, its shingle set as a 128-bit hash, its size, and its bands' keys."""

    def sign(batches):
        for batch in batches:
            h1, h2, n, bands = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)]
            for run in runs(batch.column("text")):
                h, at = shingle_sets(run, k)
                for to, salt in ((h1, 0x1F83D9ABFB41BD6B), (h2, 0x5BE0CD19137E2179)):
                    c = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix64(h ^ np.uint64(salt)), out=c[1:])
                    to.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
                n.append(np.diff(at))
                sig = minhashes(h, at).astype(np.uint64).reshape(len(run), BANDS, ROWS_A_BAND)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(run), BANDS)).copy()
                for r in range(ROWS_A_BAND):
                    key = mix64(key * np.uint64(0xD1B54A32D192ED03) + sig[:, :, r])
                bands.append(key.view(np.int64))
            b = np.concatenate(bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * BANDS, pa.int32()), pa.array(b.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *[pa.array(np.concatenate(x)) for x in (h1, h2, n)], lists], names=["doc_id", "t", "h1", "h2", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(cluster.frugal(sign), SIGNED)


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """Links within each (group, block, block) of ``members``: node, links, root."""
    need = needed(threshold)

    def work(batches):
        keys, nodes, blocks, texts, bands, held = [], [], [], [], [], 0

        def flush():
            nonlocal held
            rows = linked(keys, nodes, blocks, texts, bands, threshold, need)
            for x in (keys, nodes, blocks, texts, bands):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["node", "links", "root"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("group", "bi", "bj", "node", "block", "kept")]
            for run in runs(batch.column("text")):
                for k in range(len(run)):
                    group, bi, bj, node, block, kept = (c[run.first + k] for c in cols)
                    key = (group, bi, bj)
                    if held > BUFFER_BYTES and keys[-1] != key:
                        yield flush()
                    for x, y in zip((keys, nodes, blocks, texts, bands), (key, node, block, run.text(k), kept), strict=True):
                        x.append(y)
                    held += len(texts[-1])
        if keys:
            yield flush()

    dealt = members.repartition(cluster.parts(members.sparkSession), "group", "bi", "bj").sortWithinPartitions("group", "bi", "bj", "node")
    return dealt.mapInArrow(cluster.frugal(work), "node long, links long, root long")


def blocks_of(n: Column, shingles_: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(shingles_ / F.lit(BLOCK_SHINGLES))).cast("int")


def in_blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` (node, nb: the blocks of its group) once for each pair of blocks that its own block is in."""
    placed = rows.select(*keep, "nb", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int").alias("block"))
    placed = placed.select(*keep, "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    return placed.select(*keep, "block", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))


def dealt_out(families: DataFrame, reps: DataFrame, n_shingles: DataFrame) -> DataFrame:
    """(group, bi, bj, node, block, kept): where each class of a family meets the others.

    By default every class meets all of its family, block by block. A family whose bands
    are much smaller than itself (a chain) is dealt by band where that takes fewer rows: by
    one band of those with the same classes, whose keys a row lists in ``kept``.
    families: node, comp; reps: node, band; n_shingles: node, n_shingles.
    """
    own = families.join(n_shingles, "node")
    sizes = own.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select("comp", "n", blocks_of(F.col("n"), F.col("s")).alias("nb"))
    large = sizes.where("nb > 2").select("comp", (F.col("n") * F.col("nb")).alias("whole"))
    inside = cluster.materialise(reps.join(own.join(large, "comp"), "node").select("node", "comp", "whole", "n_shingles", "band"))
    same = inside.groupBy("band").agg(F.first("comp").alias("comp"), F.first("whole").alias("whole"), F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    one = cluster.materialise(same.groupBy("comp", "n", "low", "high", "x").agg(F.min("band").alias("band"), F.first("whole").alias("whole"), F.first("s").alias("s")).select("comp", "whole", "band", "n", blocks_of(F.col("n"), F.col("s")).alias("nb")))
    chains = one.groupBy("comp").agg(F.sum(F.col("n") * F.col("nb")).alias("rows"), F.first("whole").alias("whole")).where("rows < whole").select("comp")
    chains = cluster.materialise(chains)
    whole = own.join(sizes, "comp").join(chains, "comp", "left_anti").select(F.col("comp").alias("group"), "node", "nb", F.lit(None).cast("array<long>").alias("kept"))
    if chains.isEmpty():
        return in_blocks(whole, ["group", "node", "kept"])
    banded = inside.select("node", "band").join(one.join(chains, "comp", "left_semi").select("band", "nb"), "band")
    kept = banded.groupBy("node").agg(F.array_sort(F.collect_list("band")).alias("kept"))
    banded = banded.join(kept, "node").select(F.col("band").alias("group"), "node", "nb", "kept")
    return in_blocks(whole.unionByName(banded), ["group", "node", "kept"])


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of ``docs``: doc_id, class_id, n_links, group_id, n_shingles, text_hash, is_first.

    A class is all texts with one shingle set, whatever ids they have: class_id is the
    least of its rows' ids, or where that is null or another class's too a hash of the set.
    n_links counts the other classes whose similarity reaches ``threshold``; group_id is
    the least class_id that links connect; is_first holds for one of the group's distinct
    (doc_id, text) and its repetitions. A text without a word (or null) is like none: it is
    its own class and group, first in it, under its own id. Rows that share an id but not
    the text are documents of their own; rows without an id too.
    """
    sign = cluster.materialise(signed(docs))
    full = sign.where("n_shingles > 0")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    by_set = full.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    by_set = cluster.materialise(by_set.select("h1", "h2", F.col("first.doc_id").alias("id"), F.col("first.t").alias("t"), "n_shingles", "bands"))
    twice = by_set.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id")
    # ids of several texts are rare; their classes go by the set's hash
    classes = by_set.join(twice.withColumn("twice", F.lit(True)), "id", "left").withColumn("node", F.when(F.col("id").isNull() | F.col("twice").isNotNull(), F.xxhash64("h1", "h2")).otherwise(F.col("id"))).drop("twice")
    classes = cluster.materialise(classes)
    reps = classes.select("node", F.explode("bands").alias("band"))
    shared = reps.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("last")).where("root != last").select("band", "root")
    edges = reps.join(shared, "band").where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    families = components(edges)
    where = dealt_out(families, reps, classes.select("node", "n_shingles"))
    firsts = families.select("node").join(classes.select("node", F.col("id").alias("_id"), F.col("t").alias("_t")), "node")
    # by hash on both sides at every size: texts are the larger side, and members grow with the corpus
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    texts = firsts.hint("merge").join(rows, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("t"))).groupBy("node").agg(F.first("text").alias("text"))
    found = cluster.materialise(compared(where.join(texts, "node"), threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("comp").alias("group_id"))
    by_class = classes.select("h1", "h2", F.col("node").alias("class_id"), F.col("id").alias("_id"), F.col("t").alias("_t"), "node").join(links, "node", "left").join(groups, "node", "left").drop("node")
    first = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("t")) & (F.coalesce("group_id", "class_id") == F.col("class_id"))
    out = full.select("doc_id", "t", "h1", "h2", "n_shingles").join(by_class, ["h1", "h2"]).select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), "n_shingles", F.col("t").alias("text_hash"), first.alias("is_first"))
    bare = sign.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"), "n_shingles", F.col("t").alias("text_hash"), F.lit(True).alias("is_first"))
    return out.union(bare)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of near copies; texts without a word all stay."""
    verdict = join(docs, threshold).select("doc_id", "text_hash", "is_first", "n_shingles")
    # repetitions of one (doc_id, text) are told apart by their number only
    once = cluster.materialise(verdict.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("is_first").alias("is_first"), F.max("n_shingles").alias("s")))
    drop = once.where("not is_first or (n > 1 and s > 0)").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t"), "is_first")
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_h", F.xxhash64(F.col("_row.text")))
    same = F.col("_id").eqNullSafe(F.col("_row.doc_id").cast("long")) & (F.col("_t") == F.col("_h"))
    kept = rows.join(drop, same, "left_anti")
    again = rows.join(drop.where("is_first"), same, "left_semi").groupBy(F.col("_row.doc_id").alias("_id"), "_h").agg(F.first("_row").alias("_row"))
    return cluster.from_rows(kept.select("_row").unionByName(again.select("_row")), docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(cluster.table(spark, sf_dir, "documents")).drop("text_hash")
