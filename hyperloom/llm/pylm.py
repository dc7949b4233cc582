"""Language-model scoring with a hierarchical Pitman-Yor model.

Each previous word is a context restaurant of its own, known by its hash; they share one parent, the word restaurant, whose base is uniform over the known words and one
unknown word. The seating of a context's customers is sampled by Gibbs in its collapsed
form: the number of tables that serve a word is drawn from its conditional given all other
tables, with generalised Stirling numbers for the seatings that a number of tables stands
for. Each table is a customer of the parent. Predictive probabilities are averaged over
the samples.

The work is dealt out by word. A task holds whole words with all their contexts, so it
has a word's counts, its customers in the parent, and the probability of each of its
(context, word) pairs by itself. After each sweep the customers and tables by context are
summed in a table dealt by context and come back to the shards that asked for them; the
parent's totals and those of the words that are too frequent for one task (dealt by
context as well) pass through the driver. So probabilities belong to the seating they
are taken from, and add up to 1. A pair of one customer has one table in every seating:
only the others move, and only their contexts are asked for between sweeps.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .textops import Run, mix64, runs

#: Discount and concentration of the contexts and of their parent.
D2, THETA2 = 0.78, 5.0
D1, THETA1 = 0.6, 10.0
BURN_IN, SAMPLES = 1, 3
#: Counts up to this have their table numbers drawn exactly; beyond, tables are added by doubling counts.
EXACT = 64
#: Tokens that a map task gathers before it deals them out, and text bytes behind one shard.
GATHER_TOKENS = 1 << 21
SHARD_BYTES = 20 << 20
#: Text bytes whose documents one task sums up in the end, and the most of such tasks.
SUMMED_BYTES, MOST_SUMMED = 64 << 20, 1 << 14
#: A task deals to at most about so many others at once; beyond, tokens go by way of coarse shards and are merged there.
MOST_FAN = 2048
#: Text characters sampled to find the words that need more than one task (balance only; results don't depend on it).
HOT_SAMPLE_CHARS = 8_000_000
#: Tokens whose scores are summed by document at once.
SUM_TOKENS = 1 << 18

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)


# ---- byte form of what moves between tasks ---------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; a plane of zeros takes no room."""
    out = []
    z = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = z.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
        out.append(struct.pack("<4sQQ", a.dtype.str.encode().ljust(4), len(a), len(planes)) + planes)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at, z = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sQQ", data, at)
        at += 20
        dtype = np.dtype(kind.decode().strip())
        raw = np.frombuffer(z.decompress(data[at : at + size], max_output_size=max(1, n * dtype.itemsize)), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype))
        at += size
    return out


# ---- tokens ----------------------------------------------------------------------------


def context_of(h: np.ndarray) -> np.ndarray:
    """The context's number: 63 bits of hash, above a bit that is left to mark held-out tokens."""
    return mix64(h ^ np.uint64(0xA5A5A5A5)) & ~np.uint64(1)


def steps_of(ctx: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, which pack better."""
    return np.diff(ctx, prepend=np.uint64(0))


def tokens(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and context of each token of a run (each text ends with END), and n + 1 offsets by text."""
    low = run.lowered()
    starts, ends, offs = low.words()
    h = low.hash(starts, ends)
    out = offs + np.arange(len(offs))
    w = np.full(int(out[-1]), END, np.uint64)
    inside = np.ones(len(w), bool)
    inside[out[1:] - 1] = False
    w[inside] = h
    before = np.empty(len(w), np.uint64)
    before[1:] = w[:-1]
    before[out[:-1]] = START
    return w, context_of(before), out


class Hot:
    """Words dealt by context as well: each has ``parts`` keys of its own."""

    def __init__(self, words: list[int], parts: list[int]):
        self.words = np.array(words, np.uint64)
        self.parts = np.array(parts, np.int64)
        order = np.argsort(self.words)
        self.words, self.parts = self.words[order], self.parts[order]

    def key(self, w: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mix64(w + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def deal(self, w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return w
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == w)
        out = w.copy()
        out[hit] = self.key(w[hit], (ctx[hit] >> np.uint64(1)) % self.parts[at[hit]].astype(np.uint64))
        return out

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys of hot words, ascending, and which word each is of."""
        if not len(self.words):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(self.words)), self.parts)
        part = np.concatenate([np.arange(p) for p in self.parts])
        keys = self.key(self.words[which], part)
        order = np.argsort(keys)
        return keys[order], which[order]


def find_hot(docs: DataFrame, shards: int, chars: int) -> Hot:
    share = min(1.0, HOT_SAMPLE_CHARS / max(chars, 1))

    def count(batches):
        total: dict[str, list] = {"w": [], "n": []}
        for batch in batches:
            for run in runs(batch.column("text"), 1 << 22):
                w, n = np.unique(tokens(run)[0], return_counts=True)
                keep = n * 16 * shards >= n.sum()
                total["w"].append(np.append(w[keep], np.uint64(0)))
                total["n"].append(np.append(n[keep], n.sum()))
        if total["w"]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(total["w"]).view(np.int64)), pa.array(np.concatenate(total["n"]))], names=["w", "n"])

    got = docs.where(cluster.chance(F.coalesce("text", F.lit(""))) < share).select("text").mapInArrow(cluster.frugal(count), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 0")
    everything = got.where("w = 0").agg(F.sum("n")).first()[0] or 0
    rows = got.where((F.col("w") != 0) & (F.col("n") * 4 * shards >= everything)).collect() if everything else []
    return Hot([r["w"] & 0xFFFFFFFFFFFFFFFF for r in rows], [min(4 * shards, math.ceil(8 * shards * r["n"] / everything)) for r in rows])


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# ---- Gibbs sampling of table numbers ----------------------------------------------------


def stirling(d: float, size: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t), 0 <= t <= c <= size."""
    s = np.full((size + 1, size + 1), -np.inf)
    s[0, 0] = 0
    for c in range(size):
        for t in range(1, c + 2):
            stay = s[c, t] + math.log(c - t * d) if t <= c and c > t * d and np.isfinite(s[c, t]) else -np.inf
            s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


_STIRLING = {D1: stirling(D1), D2: stirling(D2)}


def draw_tables(c: np.ndarray, p: np.ndarray, strength: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each word given its customers ``c``, its parent's probability ``p``
    and theta + d x the restaurant's other tables (``strength``)."""
    t = np.minimum(c, 1)
    log_s = _STIRLING[d]
    low = np.minimum(c, EXACT)
    order = np.argsort(low, kind="stable")
    at = np.searchsorted(low[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        rows = order[at[n] : at[n + 1]]
        for i in range(0, len(rows), 1 << 18):
            r = rows[i : i + (1 << 18)]
            # only numbers of tables up to where all but a trace of the mass lies
            top = n
            steps = np.log(p[r][:, None] * (strength[r][:, None] + d * np.arange(top)))
            logit = np.cumsum(steps, 1) + log_s[n, 1 : top + 1]
            logit -= logit.max(1, keepdims=True)
            mass = np.cumsum(np.exp(logit), 1)
            t[r] = 1 + (mass < rng.random(len(r))[:, None] * mass[:, -1:]).sum(1)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        n, s = np.full(len(big), float(EXACT)), c[big].astype(float)
        tt = t[big].astype(float)
        while (n < s).any():
            nxt = np.minimum(2 * n, s)
            a = p[big] * (strength[big] + d * tt)
            tt += rng.poisson(a * np.log((nxt - d * tt + a) / np.maximum(n - d * tt + a, 1e-9)))
            tt = np.minimum(tt, nxt)
            n = nxt
        t[big] = tt.astype(t.dtype)
    return t


# ---- the three steps --------------------------------------------------------------------

DEALT = "shard int, g long, body binary, doc_ids array<long>, held array<boolean>, sizes array<int>"


def cut(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, grp: np.ndarray, groups: list[int], shards: int, fan: int) -> list[tuple[int, bytes]]:
    """(first shard, body) for each run of ``fan`` shards that some tokens fall to."""
    order = np.argsort(key)
    key, ctx, doc, grp = key[order], ctx[order], doc[order], grp[order]
    cuts = np.searchsorted(shard_of(key, shards) // fan, np.arange(-(-shards // fan) + 1))
    out = []
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        k, count = np.unique(key[a:b], return_counts=True)
        own, g = np.unique(grp[a:b], return_inverse=True)
        u, at = np.unique(ctx[a:b], return_inverse=True)
        out.append((int(s) * fan, packed(k, count.astype(np.uint32), steps_of(u), at.astype(np.uint32), doc[a:b], g.astype(np.uint32), np.array(groups, np.int64)[own])))
    return out


def joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The tokens of several bodies: key, context, document, number of the group, and the groups."""
    key, ctx, doc, grp, groups = [], [], [], [], []
    for body in bodies:
        k, count, u, at, n, g, own = unpacked(body)
        key.append(np.repeat(k, count))
        ctx.append(np.cumsum(u)[at])
        doc.append(n)
        grp.append(g + np.uint32(len(groups)))
        groups += own.tolist()
    return (*(np.concatenate(x) for x in (key, ctx, doc, grp)), groups)


def deal(docs: DataFrame, hot: Hot, shards: int, fan: int = 1) -> DataFrame:
    """Tokens by runs of ``fan`` shards: for a group g of documents, sorted keys with their tokens' contexts and document numbers.

    A row of shard -1 - k holds the group's document ids. docs: doc_id, text, held.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(hot)

    def work(batches):
        pid, group = TaskContext.get().partitionId(), 0
        w, ctx, doc, ids, held, sizes = [], [], [], [], [], []
        have = 0

        def flush():
            nonlocal group, have
            key, c, n = np.concatenate(w), np.concatenate(ctx), np.concatenate(doc)
            key = shipped.value.deal(key, c)
            flag = np.array(held, bool)[n]
            c = c | flag.astype(np.uint64)
            g = (pid << 24) + group
            rows = [(-1 - g % shards, g, None, ids[:], held[:], sizes[:])]
            rows += [(shard, g, body, None, None, None) for shard, body in cut(key, c, n.astype(np.uint32), np.zeros(len(key), np.uint32), [g], shards, fan)]
            for x in (w, ctx, doc, ids, held, sizes):
                x.clear()
            group += 1
            have = 0
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DEALT.split(", ")])

        for batch in batches:
            names, out = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            for run in runs(batch.column("text")):
                a, b, offs = tokens(run)
                w.append(a)
                ctx.append(b)
                doc.append(np.repeat(np.arange(len(run)) + len(ids), np.diff(offs)))
                ids += names[run.first : run.first + len(run)]
                held += out[run.first : run.first + len(run)]
                sizes += np.diff(offs).tolist()
                have += len(a)
                if have >= GATHER_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(cluster.frugal(work), DEALT)


def place_of(shards: int, fan: int) -> Column:
    """The partition of a row: ids of documents go with the shard that their group falls to."""
    at = F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(F.col("shard"))
    return F.floor(at / fan).cast("int")


def merged(dealt: DataFrame, shards: int, fan: int) -> DataFrame:
    """The second hop: what came for a run of shards is merged over groups and dealt to its shards, so that bodies stay large."""

    def work(batches):
        held, have = [], 0
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
        names = [x.split()[0] for x in DEALT.split(", ")]

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] < 0:
                    yield as_batch([tuple(r[n] for n in names)])
                    continue
                held.append(r["body"])
                have += len(r["body"])
                if have >= 4 * GATHER_TOKENS:
                    yield as_batch([(shard, 0, body, None, None, None) for shard, body in cut(*joined(held), shards, 1)])
                    held, have = [], 0
        if held:
            yield as_batch([(shard, 0, body, None, None, None) for shard, body in cut(*joined(held), shards, 1)])

    return dealt.repartitionById(-(-shards // fan), place_of(shards, fan)).mapInArrow(cluster.frugal(work), DEALT)


MOVES = "seat binary, moving array<struct<part:int,body:binary>>, hot array<struct<i:int,c:long,t:long>>, n long, v long, c1 long, t1 long"
BUILT = "shard int, g long, body binary, doc_ids array<long>, held array<boolean>, sizes array<int>, fixed array<struct<part:int,body:binary>>, " + MOVES
_ASK = pa.list_(pa.struct([("part", pa.int32()), ("body", pa.binary())]))
MOVES_KINDS = (pa.binary(), _ASK, pa.list_(pa.struct([("i", pa.int32()), ("c", pa.int64()), ("t", pa.int64())])), pa.int64(), pa.int64(), pa.int64(), pa.int64())
MOVES_NAMES = ["seat", "moving", "hot", "n", "v", "c1", "t1"]


def asked(ctx: np.ndarray, shards: int, *values: np.ndarray) -> list[dict]:
    """A shard's ascending contexts and its sums in each, by the part that adds them up."""
    cuts = np.searchsorted(shard_of(ctx, shards), np.arange(shards + 1))
    return [{"part": int(i), "body": packed(steps_of(ctx[cuts[i] : cuts[i + 1]]), *[x[cuts[i] : cuts[i + 1]] for x in values])} for i in np.flatnonzero(np.diff(cuts))]


def sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n).astype(np.int64)


def hot_sums(hot_of: np.ndarray, cw: np.ndarray, cw1: np.ndarray) -> list[dict]:
    which = np.flatnonzero(hot_of >= 0)
    own, at = np.unique(hot_of[which], return_inverse=True)
    return [{"i": int(i), "c": int(c), "t": int(t)} for i, c, t in zip(own, sum_by(at, cw[which], len(own)), sum_by(at, cw1[which], len(own)), strict=True)]


def build(dealt: DataFrame, hot: Hot, shards: int) -> DataFrame:
    """One row a shard: its words, (context, word) pairs with training counts, and tokens by pair; and what the others need of it.

    Also takes a first sample of the seating, from the shard's own estimates of the totals.
    """
    shipped = dealt.sparkSession.sparkContext.broadcast(hot)

    def build_one(shard: int, bodies: list[bytes]) -> tuple:
        hot = shipped.value
        key, ctx, doc, grp, every = joined(sorted(bodies))
        groups, of = np.unique(np.array(every, np.int64), return_inverse=True)
        grp = of[grp].astype(np.uint32)
        words, word = np.unique(key, return_inverse=True)
        del key, bodies, every, of
        train = (ctx & np.uint64(1)) == 0
        ctxs, at = np.unique(ctx >> np.uint64(1) << np.uint64(1), return_inverse=True)
        pair = (word.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)
        del word, ctx, at
        order = np.argsort(pair, kind="stable")
        pair, doc, grp, train = pair[order], doc[order], grp[order], train[order]
        del order
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        many = np.diff(np.append(first, len(pair)))
        c = np.add.reduceat(train.astype(np.int64), first)
        pw, pc = (pair[first] >> np.uint64(32)).astype(np.int64), (pair[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del pair
        cw = sum_by(pw, c, len(words))
        rng = np.random.default_rng([shard, 0])
        n = int(cw.sum())
        several = np.flatnonzero(c > 1)
        # the first seating goes by the shard's own estimates of the totals
        types = np.bincount(pc[c > 0], minlength=len(ctxs))
        strength = THETA2 + D2 * np.maximum(types * shards - 1, 0)
        t = draw_tables(c[several], cw[pw[several]] / max(n * shards, 1), strength[pc[several]], D2, rng)
        single = sum_by(pw, c == 1, len(words))
        cw1 = single + sum_by(pw[several], t, len(words))
        keys, which = hot.known()
        at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
        is_hot = keys[at] == words if len(keys) else np.zeros(len(words), bool)
        hot_of = np.where(is_hot, which[at] if len(keys) else 0, -1).astype(np.int32)
        v = int(((cw > 0) & ~is_hot).sum())
        tw1 = np.zeros(len(words), np.int64)
        tw1[~is_hot] = draw_tables(cw1[~is_hot], np.full((~is_hot).sum(), 1 / max(v * shards + 1, 1)), np.full((~is_hot).sum(), THETA1 + D1 * v * shards), D1, rng)
        fixed = asked(ctxs, shards, sum_by(pc, c, len(ctxs)), sum_by(pc, c == 1, len(ctxs)))
        body = packed(hot_of, cw, np.bincount(pw, minlength=len(words)).astype(np.uint32), steps_of(ctxs), pc.astype(np.uint32), c.astype(np.uint32), many.astype(np.uint32), doc, grp, groups)
        own, at = np.unique(pc[several], return_inverse=True)
        moving = asked(ctxs[own], shards, sum_by(at, t, len(own)))
        seat = packed(hot_of, single.astype(np.uint32), np.bincount(pw[several], minlength=len(words)).astype(np.uint32), steps_of(ctxs[own]), np.zeros(len(own), np.uint32), at.astype(np.uint32), c[several].astype(np.uint32), t.astype(np.uint32), tw1.astype(np.uint32))
        return (shard, None, body, None, None, None, fixed, seat, moving, hot_sums(hot_of, cw, cw1), n, v, int(cw1.sum()), int(tw1.sum()))

    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), _ASK, *MOVES_KINDS)
    names = ["shard", "g", "body", "doc_ids", "held", "sizes", "fixed", *MOVES_NAMES]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def work(batches):
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] < 0:
                    yield as_batch([(r["shard"], r["g"], None, r["doc_ids"], r["held"], r["sizes"], None, None, None, None, 0, 0, 0, 0)])
                else:
                    parts.setdefault(r["shard"], []).append(r["body"])
        for shard in sorted(parts):
            yield as_batch([build_one(shard, parts.pop(shard))])

    return dealt.repartitionById(shards, place_of(shards, 1)).mapInArrow(cluster.frugal(work), BUILT)


def totals(state: DataFrame, hot: Hot, before: dict | None = None) -> dict:
    """The parent's totals and those of hot words, over all shards: sizes that don't depend on the corpus."""
    one = state.agg(F.sum("n"), F.sum("v"), F.sum("c1"), F.sum("t1")).first()
    n, v, c1, t1 = (int(x or 0) for x in one)
    hc, ht = np.zeros(len(hot.words), np.int64), np.zeros(len(hot.words), np.int64)
    for r in state.select(F.explode("hot").alias("h")).groupBy("h.i").agg(F.sum("h.c").alias("c"), F.sum("h.t").alias("t")).collect():
        hc[r["i"]], ht[r["i"]] = r["c"], r["t"]
    if before:  # the counts stay, only tables move
        n, v, hc = before["n"], before["v"], before["hc"]
    else:
        v += int((hc > 0).sum())
    rng = np.random.default_rng([1, before["sweep"] + 1 if before else 0])
    ht1 = draw_tables(ht, np.full(len(ht), 1 / (v + 1)), np.full(len(ht), THETA1 + D1 * t1), D1, rng)
    return {"n": n, "v": v, "c1": c1, "t1": t1 + int(ht1.sum()), "hc": hc, "ht": ht, "ht1": ht1, "sweep": before["sweep"] + 1 if before else 0}


FOUND = "shard int, part int, body binary"


def asks(table: DataFrame, column: str, kind: int) -> DataFrame:
    return table.select("shard", F.lit(kind).alias("kind"), F.explode(column).alias("a")).select("shard", "kind", "a.part", "a.body")


def exchange(rows: DataFrame, shards: int, kind: int, seatings: int) -> DataFrame:
    """Sums over shards by context: customers, tables of pairs of one customer, and the moving tables.

    rows: fixed ones (kind 0: customers, tables of one customer) and moving ones (kind 1: one
    sum for each of ``seatings``). Those of ``kind`` are answered, context by context.
    """

    def add(batches):
        shard, kinds, bodies, part = [], [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                part = r["part"]
                shard.append(r["shard"])
                kinds.append(r["kind"])
                bodies.append(unpacked(r["body"]))
        if not bodies:
            return
        sizes = [len(x[0]) for x in bodies]
        every, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in bodies]), return_inverse=True)
        ends = np.cumsum(sizes)
        sums = np.zeros((2 + seatings, len(every)), np.int64)
        for x, k, end in zip(bodies, kinds, ends, strict=True):
            for i, y in enumerate(x[1:]):
                sums[2 * k + i][at[end - len(y) : end]] += y
        for s, k, end, size in zip(shard, kinds, ends, sizes, strict=True):
            if k == kind:
                mine = at[end - size : end]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(*[x[mine] for x in sums])], pa.binary())], names=["shard", "part", "body"])

    return rows.repartitionById(shards, F.col("part")).mapInArrow(cluster.frugal(add), FOUND)


def answers(parts: dict[int, bytes]) -> list[np.ndarray]:
    """The sums for all contexts a shard asked for, in their order."""
    got = [unpacked(parts[i]) for i in sorted(parts)]
    return [np.concatenate(x) for x in zip(*got, strict=True)]


def parent(all_: dict, hot_of: np.ndarray, cw1: np.ndarray, tw1: np.ndarray) -> np.ndarray:
    """Probability of each word in the parent restaurant."""
    hot = hot_of >= 0
    cw1, tw1 = cw1.copy(), tw1.astype(np.int64)
    cw1[hot], tw1[hot] = all_["ht"][hot_of[hot]], all_["ht1"][hot_of[hot]]
    return (cw1 - D1 * tw1 + (THETA1 + D1 * all_["t1"]) / (all_["v"] + 1)) / (THETA1 + all_["c1"])


def seating(seat: bytes) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """What stays of a shard's seating, and the tables of pairs and of words in each kept seating."""
    x = unpacked(seat)
    m = (len(x) - 7) // 2
    return x[:7], x[7 : 7 + m], x[7 + m :]


def sweep_shard(shard: int, seat: bytes, parts: dict[int, bytes], all_: dict, shards: int) -> tuple:
    (hot_of, single, per_word, steps, known, pc, c), ts, tw1s = seating(seat)
    pw = np.repeat(np.arange(len(single)), per_word)
    c, t, single = c.astype(np.int64), ts[-1].astype(np.int64), single.astype(np.int64)
    rng = np.random.default_rng([shard, 1 + all_["sweep"]])
    cw1 = single + sum_by(pw, t, len(single))
    p1 = parent(all_, hot_of, cw1, tw1s[-1])
    if len(c):
        _, ones, moved = answers(parts)
        known = known + ones
        t = draw_tables(c, p1[pw], THETA2 + D2 * np.maximum((known + moved)[pc] - t, 0), D2, rng)
        cw1 = single + sum_by(pw, t, len(single))
    mine = hot_of < 0
    tw1 = np.zeros(len(single), np.int64)
    tw1[mine] = draw_tables(cw1[mine], np.full(mine.sum(), 1 / (all_["v"] + 1)), THETA1 + D1 * np.maximum(all_["t1"] - tw1s[-1][mine].astype(np.float64), 0), D1, rng)
    keep = all_["sweep"] >= BURN_IN
    ts, tw1s = [*(ts if keep else []), t.astype(np.uint32)], [*(tw1s if keep else []), tw1.astype(np.uint32)]
    # the last sweep's tables alone are needed for the next, all kept ones for the scores
    last = all_["sweep"] + 1 == BURN_IN + SAMPLES - 1
    moving = asked(np.cumsum(steps), shards, *[sum_by(pc, x, len(steps)) for x in (ts if last else ts[-1:])])
    new = packed(hot_of, single.astype(np.uint32), per_word, steps, known.astype(np.uint32), pc, c.astype(np.uint32), *ts, *tw1s)
    return (shard, new, moving, hot_sums(hot_of, np.zeros(len(single)), cw1), 0, 0, int(cw1.sum()), int(tw1.sum()))


def sweep(state: DataFrame, found: DataFrame, all_: dict, shards: int) -> DataFrame:
    """The next seating of every shard, from the totals of the present one."""
    shipped = state.sparkSession.sparkContext.broadcast(all_)

    def work(batches):
        seats, parts = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] is None:
                    seats[r["shard"]] = r["body"]
                else:
                    parts.setdefault(r["shard"], {})[r["part"]] = r["body"]
        for shard in sorted(seats):
            row = sweep_shard(shard, seats.pop(shard), parts.pop(shard, {}), shipped.value, shards)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), *MOVES_KINDS), strict=True)], names=["shard", *MOVES_NAMES])

    rows = state.select("shard", F.lit(None).cast("int").alias("part"), F.col("seat").alias("body")).unionByName(found)
    return rows.repartitionById(shards, F.col("shard")).mapInArrow(cluster.frugal(work), "shard int, " + MOVES)


def pair_probabilities(body: list[np.ndarray], seat: bytes, parts: dict[int, bytes], kept: list[dict]) -> np.ndarray:
    """Predictive probability of each (context, word) pair of a shard, averaged over the kept seatings."""
    hot_of, _, per_word, _, pc, c = body
    (_, single, per_several, *_), ts, tw1s = seating(seat)
    pw = np.repeat(np.arange(len(per_word)), per_word)
    sw = np.repeat(np.arange(len(per_word)), per_several)
    several = np.flatnonzero(c > 1)
    cu, ones, *moved = answers(parts)
    out = np.zeros(len(c))
    for all_, t, tw1, more in zip(kept, ts, tw1s, moved, strict=True):
        p1 = parent(all_, hot_of, single.astype(np.int64) + sum_by(sw, t, len(per_word)), tw1)
        own = np.where(c > 0, c - D2, 0.0)
        own[several] = c[several] - D2 * t
        out += (own + (THETA2 + D2 * (ones + more))[pc] * p1[pw]) / (THETA2 + cu)[pc]
    return out / len(kept)


def score_shard(body: bytes, seat: bytes, found: dict[int, bytes], kept: list[dict], parts: int) -> list[tuple]:
    """Scores of a shard's pairs, then sums by document, one row for each task that gathers some."""
    hot_of, cw, per_word, steps, pc, c, many, doc, grp, groups = unpacked(body)
    pair_score = np.log10(pair_probabilities([hot_of, cw, per_word, steps, pc, c], seat, found, kept))
    pw = np.repeat(np.arange(len(cw)), per_word)
    hot = hot_of >= 0
    cw = cw.copy()
    cw[hot] = kept[0]["hc"][hot_of[hot]]
    n, v = kept[0]["n"], kept[0]["v"]
    word_base = np.log10((cw + 1.0) / (n + v + 1.0))
    score, flat = np.repeat(pair_score, many), np.repeat(pw, many)
    del pair_score, pw, pc, c
    # sums by (group, document), a run of groups at a time
    order = np.argsort(grp, kind="stable")
    bounds = np.searchsorted(grp[order], np.arange(len(groups) + 1))
    found: list[list[np.ndarray]] = [[], [], [], []]
    i = 0
    while i < len(groups):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SUM_TOKENS, "right")) - 1)
        rows = order[bounds[i] : bounds[j]]
        slot, which = np.unique((grp[rows].astype(np.int64) << 32) | doc[rows], return_inverse=True)
        word = flat[rows]
        sums = (slot, np.bincount(which, weights=cw[word] > 0).astype(np.uint32), np.bincount(which, weights=score[rows]).astype("<f4"), np.bincount(which, weights=word_base[word]).astype("<f8"))
        for x, y in zip(found, sums, strict=True):
            x.append(y)
        i = j
    slot, known, s, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    home = part_of(groups, parts)[slot >> 32]
    rank = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[rank], np.arange(parts + 1))
    out = []
    for part in np.flatnonzero(np.diff(cuts)):
        mine = rank[cuts[part] : cuts[part + 1]]
        own, g = np.unique(slot[mine] >> 32, return_inverse=True)
        out.append((int(part), packed(groups[own], g.astype(np.uint32), (slot[mine] & 0xFFFFFFFF).astype(np.uint32), known[mine]), s[mine].tobytes(), b[mine].tobytes()))
    return out


def part_of(g: np.ndarray, parts: int) -> np.ndarray:
    """The gathering task of each group of documents."""
    return (mix64(np.asarray(g, np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(built: DataFrame, state: DataFrame, found: DataFrame, kept: list[dict], shards: int) -> DataFrame:
    shipped = built.sparkSession.sparkContext.broadcast(kept)
    # as many tasks as there are shards for so many bytes
    parts = min(MOST_SUMMED, max(cluster.parts(built.sparkSession), math.ceil(shards * SHARD_BYTES / SUMMED_BYTES)))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
    summed = "part int, docs binary, score binary, base binary, g long, doc_ids array<long>, held array<boolean>, sizes array<int>"
    names = [x.split()[0] for x in summed.split(", ")]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield as_batch([(int(part_of([r["g"]], parts)[0]), None, None, None, r["g"], r["doc_ids"], r["held"], r["sizes"])])

    def sums(batches):
        bodies, seats, got = {}, {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] is None:
                    (bodies if r["part_of_body"] else seats)[r["shard"]] = r["body"]
                else:
                    got.setdefault(r["shard"], {})[r["part"]] = r["body"]
        for shard in sorted(bodies):
            rows = [(*x, None, None, None, None) for x in score_shard(bodies.pop(shard), seats.pop(shard), got.pop(shard), shipped.value, parts)]
            if rows:
                yield as_batch(rows)

    def gather(batches):
        held: dict[int, dict] = {}
        n = shipped.value[0]["n"]
        for batch in batches:
            for r in batch.to_pylist():
                if r["g"] is not None:  # all of a task's documents come before their sums
                    k = len(r["doc_ids"])
                    held[r["g"]] = {"ids": r["doc_ids"], "held": r["held"], "sizes": r["sizes"], "known": np.zeros(k, np.int64), "base": np.zeros(k), "score": np.zeros(k)}
                    continue
                groups, g, doc, known = unpacked(r["docs"])
                score_, base = np.frombuffer(r["score"], "<f4"), np.frombuffer(r["base"], "<f8")
                cuts = np.searchsorted(g, np.arange(len(groups) + 1))
                for i, own in enumerate(groups.tolist()):
                    mine = slice(cuts[i], cuts[i + 1])
                    x, at = held[own], doc[mine]
                    x["known"][at] += known[mine]
                    x["score"][at] += score_[mine]
                    x["base"][at] += base[mine]
        for g in sorted(held):
            x = held.pop(g)
            k = len(x["ids"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["ids"], pa.int64()), pa.array(x["held"], pa.bool_()), pa.array(x["sizes"], pa.int64()), pa.array(x["known"]), pa.array(np.full(k, n, np.int64)), pa.array(x["base"]), pa.array(x["score"])],
                names=[y.split()[0] for y in RESULT.split(", ")],
            )

    none = F.lit(None).cast("int")
    rows = built.where("shard >= 0").select("shard", none.alias("part"), "body", F.lit(True).alias("part_of_body"))
    rows = rows.unionByName(state.select("shard", none.alias("part"), F.col("seat").alias("body"), F.lit(False).alias("part_of_body")))
    rows = rows.unionByName(found.withColumn("part_of_body", F.lit(False)))
    out = rows.repartitionById(shards, F.col("shard")).mapInArrow(cluster.frugal(sums), summed)
    out = out.unionByName(built.where("shard < 0").select("g", "doc_ids", "held", "sizes").mapInArrow(cluster.frugal(documents), summed))
    return out.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("g").isNull()).mapInArrow(cluster.frugal(gather), RESULT)


def fitted(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[dict], int]:
    """What scores are made of: the shards, their last state with the kept seatings, sums by context, and totals of each kept seating."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(cluster.parts(docs.sparkSession), math.ceil(chars / SHARD_BYTES))
    hot = find_hot(docs, shards, chars)
    fan = -(-shards // MOST_FAN)
    dealt = deal(docs.select("doc_id", "text", "held"), hot, shards, fan)
    built = cluster.materialise(build(dealt if fan == 1 else merged(dealt, shards, fan), hot, shards))
    body = built.where("shard >= 0")
    state, all_ = body.select("shard", *MOVES_NAMES), None
    kept = []
    for k in range(BURN_IN + SAMPLES):
        all_ = totals(state, hot, all_)
        if k >= BURN_IN:
            kept.append(all_)
        if k == BURN_IN + SAMPLES - 1:
            break
        rows = asks(state, "moving", 1)
        found = exchange(rows if k else rows.unionByName(asks(body, "fixed", 0)), shards, 1, 1)
        state = cluster.materialise(sweep(state, found, all_, shards))
    found = exchange(asks(body, "fixed", 0).unionByName(asks(state, "moving", 1)), shards, 0, SAMPLES)
    return built, state, found, kept, shards


def train_and_score(docs: DataFrame) -> DataFrame:
    """Scores all rows of ``docs`` (doc_id, text, held) by a model of those that aren't held out.

    A null or empty text is its end token alone. Repeated rows count each time. With
    nothing to learn from, every token has the base probability of an unknown word.
    """
    return score(*fitted(docs))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cluster.table(spark, sf_dir, "documents")
    return train_and_score(docs.select("doc_id", "text", cluster.fold("doc_id", 7, 2).alias("held")))
