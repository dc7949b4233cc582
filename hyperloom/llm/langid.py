"""Language ID by prediction by partial matching (PPM).

Per language, byte contexts of up to ``ORDER`` bytes hold symbol counts; a symbol unseen
in a context is reached through an escape (method C: as many escape counts as distinct
symbols) to the next shorter context with the seen symbols excluded, down to a uniform
order.  The statistics are frozen after training, so the whole model is one table of exact
code lengths by (context, next byte, language), and a text costs a few array look-ups a
byte.  The longer contexts are the most frequent ones that the table has room for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .textops import CHUNK_BYTES, Run, folded, runs

ORDER = 4
#: Training texts of about so many characters a language are drawn, and in all.
SAMPLE_CHARS, ALL_CHARS = 1_500_000, 12_000_000
#: Contexts that training has fewer times are no better than shorter ones. Cells of the table of code lengths.
MIN_CONTEXT, CELLS = 3, 1 << 23
#: Bits of evidence counted at most, so that scores stay informative for long texts.
EVIDENCE_BYTES = 200

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # 256 -> 1..; 0 is a text's start, 1 any byte that training lacks
    steps: list[np.ndarray]  # steps[k]: (context of k bytes, symbol) -> context of k + 1 bytes
    code: np.ndarray  # (context * symbols + symbol, language) -> code length in bits

    def bits(self, run: Run) -> np.ndarray:
        """Code length of each text under each language, in bits. A text much longer than a run is taken in pieces."""
        if len(run) > 1 or len(run.buf) <= 2 * CHUNK_BYTES:
            return self._bits(run, 0)
        out, order = np.zeros((1, len(self.langs))), len(self.steps)
        for i in range(0, len(run.buf), CHUNK_BYTES):
            piece = run.buf[max(0, i - order) : i + CHUNK_BYTES]
            out += self._bits(Run(piece, np.array([0, len(piece)])), min(i, order))
        return out

    def _bits(self, run: Run, skip: int) -> np.ndarray:
        """skip: bytes of the text that only serve as context."""
        n, a = len(run), len(self.steps[0])
        sym = np.zeros(len(run.buf) + n, np.int32)
        starts = run.offs[:-1] + np.arange(n)
        inside = np.ones(len(sym), bool)
        inside[starts] = False
        sym[inside] = self.symbol[folded(run.buf)]
        level = self.steps[0][sym]
        best = level.copy()
        for step in self.steps[1:]:
            nxt = np.zeros_like(level)
            nxt[1:] = step[level[:-1].astype(np.int64) * a + sym[1:]]
            level = nxt
            np.copyto(best, level, where=level > 0)
        at = np.zeros(len(sym), np.int64)
        at[1:] = best[:-1].astype(np.int64) * a + sym[1:]
        inside[: skip + 1] &= skip == 0
        out = np.zeros((n, len(self.langs)))
        which = np.repeat(np.arange(n), np.diff(np.append(starts, len(sym))))
        step = max(1, (1 << 18) // len(self.langs))
        for i in range(0, len(sym), step):
            cost = self.code[at[i : i + step]].astype(np.float64)
            cost[~inside[i : i + step]] = 0
            own = which[i : i + step]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[first]] += np.add.reduceat(cost, first, axis=0)
        return out


def train(samples: dict[str, list[str]], order: int = ORDER) -> Model | None:
    langs = sorted(k for k, v in samples.items() if any(v))
    if not langs:
        return None
    seqs = [[np.frombuffer(t.encode(), np.uint8) for t in sorted(samples[k]) if t] for k in langs]
    present = np.zeros(256, bool)
    for texts in seqs:
        for t in texts:
            present[folded(t)] = True
    symbol = np.ones(256, np.int32)
    symbol[present] = np.arange(present.sum()) + 2
    a = int(present.sum()) + 2
    streams = []
    for texts in seqs:
        streams.append(np.concatenate([x for t in texts for x in (np.zeros(1, np.int32), symbol[folded(t)])]))
    steps: list[np.ndarray] = [np.arange(1, a + 1, dtype=np.int32)]
    levels = [steps[0][s] for s in streams]
    suffix = [np.zeros(1, np.int64)]  # a context's next shorter context; 0 is the empty one
    counts = [np.stack([np.bincount(s[s > 0], minlength=a) for s in streams], 1)[None]]
    suffix.append(np.zeros(a, np.int64))
    total = a + 1

    def tally(level: list[np.ndarray], base: int, size: int) -> np.ndarray:
        out = []
        for c, s in zip(level, streams, strict=True):
            ok = (c[:-1] >= base) & (s[1:] > 0)
            out.append(np.bincount((c[:-1][ok] - base) * a + s[1:][ok], minlength=size * a).astype(np.int32).reshape(size, a))
        return np.stack(out, 2)

    counts.append(tally(levels, 1, a))
    shorter, base_before = steps[0], 1
    for _ in range(1, order):
        key = [np.where((c[:-1] >= base_before) & (s[1:] > 0), c[:-1].astype(np.int64) * a + s[1:], -1) for c, s in zip(levels, streams, strict=True)]
        # stream by stream, so that only distinct keys meet
        each = [np.unique(k[k >= 0], return_counts=True) for k in key]
        seen, at = np.unique(np.concatenate([x for x, _ in each]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([y for _, y in each]), minlength=len(seen)).astype(np.int64)
        ok = n >= MIN_CONTEXT
        room = max(0, CELLS // (a * len(langs)) - total)
        if ok.sum() > room:  # the most frequent ones; among equals the first
            ok[np.argsort(-np.where(ok, n, 0), kind="stable")[room:]] = False
        keep = seen[ok]
        step = np.zeros(total * a, np.int32)
        step[keep] = np.arange(len(keep)) + total
        # drop a context's first byte: the suffix of the context before, extended by the same byte
        flat = np.concatenate(suffix)
        lower = shorter[keep % a] if len(steps) == 1 else shorter[flat[keep // a] * a + keep % a]
        suffix.append(np.where(lower > 0, lower, steps[0][keep % a]).astype(np.int64))
        nxt = []
        for k in key:
            c = np.zeros(len(k) + 1, np.int32)
            c[1:] = np.where(k >= 0, step[np.maximum(k, 0)], 0)
            nxt.append(c)
        levels, base_before = nxt, total
        counts.append(tally(levels, total, len(keep)))
        steps.append(step)
        shorter = step
        total += len(keep)
    flat = np.concatenate(suffix)
    prob = np.empty((total, a, len(langs)), np.float32)
    at = 0
    for block in counts:
        for i in range(0, len(block), 1024):  # a context needs those of shorter levels only
            part = block[i : i + 1024]
            n = part.sum(1, keepdims=True)
            q = (part > 0).sum(1, keepdims=True)
            size = len(part)
            low = prob[flat[at : at + size]].astype(np.float64) if at else np.full((1, a, len(langs)), 1.0 / (a - 1))
            if not at:
                low[:, 0] = 0
            rest = np.where(part > 0, 0.0, low)
            mass = rest.sum(1, keepdims=True)
            esc = np.where(n > 0, q / np.maximum(n + q, 1), 1.0)
            esc = np.where(mass > 0, esc, 0.0)
            known = part / np.maximum(n, 1)
            prob[at : at + size] = (1 - esc) * known + esc * rest / np.where(mass > 0, mass, 1.0)
            at += size
    with np.errstate(divide="ignore"):  # a text's start is never coded
        np.log2(prob, out=prob)
    return Model(langs, symbol, steps, np.negative(prob, out=prob).reshape(total * a, len(langs)))


def fit(docs: DataFrame, seen=None, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Trains on a sample of about ``sample_chars`` characters of each language, ALL_CHARS of all, drawn by text hash; of one text as many at most."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (seen if seen is not None else F.lit(True)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    sizes = {k: v for k, v in sizes.items() if v}
    if not sizes:
        return None
    most = max(1, min(sample_chars, ALL_CHARS // len(sizes)))
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, most / v))])
    picked = rows.where(cluster.chance(F.col("text")) < F.try_element_at(share, F.col("lang"))).select("lang", F.substring("text", 1, most).alias("text")).distinct()
    samples: dict[str, list[str]] = {}
    for r in picked.collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return train(samples)


def has_letter(run: Run) -> np.ndarray:
    out = run.per_text(_ASCII_LETTER[run.buf]) > 0
    for i in np.flatnonzero(~out & (np.diff(run.offs) > 0)):
        out[i] = any(c.isalpha() for c in run.text(i).decode("utf-8", "replace"))
    return out


def predict(run: Run, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    n = len(run)
    size = np.diff(run.offs)
    ok = has_letter(run)
    if model is None:
        return ["und"] * n, np.zeros(n), np.zeros(n)
    bits = model.bits(run)
    rate = bits / np.maximum(size, 1)[:, None]
    logit = -rate * np.log(2) * np.minimum(size, EVIDENCE_BYTES)[:, None]
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    score = np.where(ok, p[np.arange(n), best], 0.0)
    return [model.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)], score, np.where(ok, rate[np.arange(n), best], 0.0)


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, with lang_pred, score and bits_per_byte of its text.

    Null texts and texts without a letter get ``und`` and score 0; ties go to the
    language that sorts first. Long texts are coded whole. Repeated rows are scored alike,
    each in its own row.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def score(batches):
        for batch in batches:
            langs, scores, rates = [], [np.zeros(0)], [np.zeros(0)]
            for run in runs(cluster.texts_of(batch)):
                lang, s, r = predict(run, shipped.value)
                langs += lang
                scores.append(s)
                rates.append(r)
            cols = [batch.column(k) for k in keep] + [pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rates))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "bits_per_byte"])

    return cluster.kept_and_text(docs, keep).mapInArrow(cluster.frugal(score), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cluster.table(spark, sf_dir, "documents")
    held = cluster.fold("doc_id", 4, 2)
    model = fit(docs, ~held)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return identify(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
