"""Vectorised text primitives over Arrow string buffers.

Python operators of this package receive Arrow batches and never build a Python string
per word: a batch's UTF-8 buffer is viewed as a numpy array, words are spans of it, and
span hashes come from one polynomial prefix sum.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in runs of about this many bytes; a longer text is a run of its own.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_Q = 0x9E3779B97F4A7C15 | 1
_QI = pow(_Q, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 24:
            _POWERS[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Run:
    """Consecutive texts of a batch: ``buf`` their bytes, ``offs`` their n + 1 offsets."""

    __slots__ = ("_prefix", "buf", "first", "offs")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int = 0):
        self.buf, self.offs, self.first, self._prefix = buf, offs, first, None

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def lowered(self) -> Run:
        return Run(LOWER[self.buf], self.offs, self.first)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of true bytes in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def code_points(self) -> np.ndarray:
        return self.per_text((self.buf & 0xC0) != 0x80)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of true bytes within a text: starts, ends, and n + 1 offsets by text."""
        n = len(inside)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(self.offs), np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        before = np.empty(n, bool)
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
        starts = np.flatnonzero(inside & (before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1] = True
        np.logical_not(inside[1:], out=after[:-1])
        ends = np.flatnonzero(inside & (after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of [^\\x20\\x09-\\x0D]+."""
        return self.spans(~_SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Non-empty \\n-split lines."""
        return self.spans(self.buf != 10)

    def forget(self) -> None:
        """Lets go of what ``hash`` keeps, eight times the run's bytes, for runs that are held on to."""
        self._prefix = None

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span's bytes."""
        if self._prefix is None:
            c = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _powers(_Q, len(self.buf)), out=c[1:])
            self._prefix = c
        c = self._prefix
        h = (c[ends] - c[starts]) * _powers(_QI, len(self.buf) + 1)[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Run]:
    """Views of an Arrow string column, about ``limit`` bytes each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Run(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with Latin capitals lowered: ASCII, and the second byte of U+00C0 to U+00DE but for U+00D7."""
    out = LOWER[buf]
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def lowered_text(run: Run) -> Run:
    """The run in lower case; texts beyond Latin-1 by the whole of Unicode."""
    wide = np.flatnonzero(run.per_text(run.buf > 0xC3)) if len(run.buf) and run.buf.max() > 0xC3 else []
    if not len(wide):
        return Run(folded(run.buf), run.offs, run.first)
    texts = [folded(run.buf[run.offs[i] : run.offs[i + 1]]).tobytes() for i in range(len(run))]
    for i in wide:
        texts[i] = run.text(i).decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape")
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return Run(np.frombuffer(b"".join(texts), np.uint8), offs, run.first)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text each, a longer text in a piece of its own."""
    for run in runs(batch.column(column), limit):
        yield batch.slice(run.first, len(run))


def owner(offs: np.ndarray) -> np.ndarray:
    """The text's number for each span, from offsets by text."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def shingles(h: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive word hashes of a text, and n + 1 offsets by text.

    A text of 1 to k - 1 words gives one shingle of all its words.
    """
    n = np.diff(offs)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.repeat(offs[:-1] - out[:-1], count) + np.arange(out[-1])
    size = np.repeat(np.minimum(n, k), count)
    v = np.zeros(len(at), np.uint64)
    last = max(len(h) - 1, 0)
    for j in range(k):
        step = v * np.uint64(0xD1B54A32D192ED03) + h[np.minimum(at + j, last)] if len(h) else v
        v = np.where(size > j, step, v) if (n < k).any() else step
    return mix64(v + size.astype(np.uint64)), out
