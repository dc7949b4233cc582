"""Best-fit packing by large-item matching, planned on the histogram of lengths.

Where items of one length are alike, a plan only needs their number: at most ``capacity``
numbers, whatever the corpus. Items above a third of the capacity pair at most twice a
bin by greedy matching, the largest with the largest that fits; smaller ones then fill
the smallest gap that takes them, longest first. The plan is a list of bin kinds with
multiplicities; every item then finds its slot from its length and its rank among items
of that length, without any item meeting another.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import cluster
from .textops import runs, slices

CAPACITY = 4096
END = 1
#: Distinct words whose ids a worker remembers, twice at most; words of more letters aren't remembered.
MEMO_WORDS, MEMO_LETTERS = 160_000, 64
_ODD = "\x1c\x1d\x1e\x1f"
#: Words of Latin-1 letters, with a stop or comma: the tokenizer's own splitting has nothing to decide there.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: b for b in same} | {b: 256 + n for n, b in enumerate(rest)}


#: Items of one length are ranked in groups of about so many.
GROUP_ROWS = 1 << 20
LEAST_SALTS = 64


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin kinds (multiplicity, [(length, items of it in a bin), ...]) that hold all items."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    kinds: list[tuple[int, int, tuple | None]] = []  # gap, multiplicity, contents as a linked list
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else None
        if b == a:
            m = left[a] // 2
            if m:
                kinds.append((capacity - 2 * a, m, (a, 2, None)))
            if left[a] % 2:
                lower = large[k - 1] if k > 0 else None
                if lower is None:
                    kinds.append((capacity - a, 1, (a, 1, None)))
                else:
                    kinds.append((capacity - a - lower, 1, (lower, 1, (a, 1, None))))
                    left[lower] -= 1
                    if not left[lower]:
                        large.remove(lower)
            large.remove(a)
            continue
        if b is None:
            kinds.append((capacity - a, left[a], (a, 1, None)))
            large.pop()
            continue
        m = min(left[a], left[b])
        kinds.append((capacity - a - b, m, (b, 1, (a, 1, None))))
        for n in (a, b):
            left[n] -= m
            if not left[n]:
                large.remove(n)
    gaps: dict[int, list[tuple[int, tuple | None]]] = {}
    for gap, m, held in kinds:
        gaps.setdefault(gap, []).append((m, held))
    order = sorted(gaps)

    def put(gap: int, m: int, held: tuple | None) -> None:
        if gap not in gaps:
            bisect.insort(order, gap)
            gaps[gap] = []
        gaps[gap].append((m, held))

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                if todo >= each:
                    put(capacity - each * n, todo // each, (n, each, None))
                if todo % each:
                    put(capacity - todo % each * n, 1, (n, todo % each, None))
                break
            gap = order[at]
            m, held = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = min(gap // n, todo)  # the gap that is left is the smallest again while it fits
            use = min(m, todo // each)
            put(gap - each * n, use, (n, each, held))
            if m > use:
                put(gap, m - use, held)
            todo -= use * each
    out = []
    for gap in order:
        for m, held in gaps[gap]:
            inside = []
            while held is not None:
                inside.append((held[0], held[1]))
                held = held[2]
            out.append((m, inside[::-1]))
    return out


def slots(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): sequence of that rank, items of it a bin, offset in the bin."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for m, inside in kinds:
        at = 0
        for n, each in inside:
            r = used.get(n, 0)
            rows.append(((n << 44) + r, base, each, at))
            used[n] = r + m * each
            at += n * each
        base += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("key", "base", "each", "at"), cols.T.copy(), strict=True))


class Encoder(dict):
    """Token ids as little-endian bytes, remembered by word.

    The tokenizer drops white space before it splits, so a text's ids are those of its
    words in turn. Texts with U+001C to U+001F, which Python splits at and the tokenizer
    doesn't, are encoded whole. A worker keeps its encoder between tasks; of the words it
    remembers, those not met again while as many new ones came are forgotten.
    """

    _kept: ClassVar[dict[str, Encoder]] = {}

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.characters = byte_characters()
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            plain = _PLAIN.fullmatch(word)
            if plain:
                letters, stop = plain.groups()
                low = letters.lower()
                if not low.isascii():
                    low = low.encode().decode("latin-1").translate(self.characters)
                ids = array("I", [t.id for t in self.merge(low)]).tobytes()
                if stop:
                    ids += self[stop]
            else:
                ids = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= MEMO_LETTERS:
            self[word] = ids
        return ids

    def __call__(self, text: str, latin: bool = False) -> bytes:
        """latin: whether all of ``text`` is ASCII or Latin-1, where lower case has no exceptions."""
        if any(c in text for c in _ODD):
            return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        if latin:
            text = text.lower()  # as the tokenizer would, but words differ less
        if len(self) > MEMO_WORDS:
            self.older = self.copy()
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def latin_texts(texts: pa.Array) -> list[bool]:
    """Whether each text has only characters up to U+00FF."""
    return [ok for run in runs(texts) for ok in (run.per_text(run.buf > 0xC3) == 0).tolist()]


PIECES = "doc_id long, piece integer, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A document's ids and the end id, cut only where longer than ``capacity``. Null and empty texts are the end id alone."""
    where = tokenizer or default_tokenizer()
    end = np.array([END], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches):
        encode = Encoder.of(where)
        for whole in batches:
            for batch in slices(whole):
                rows: list[list] = [[], [], [], [], []]
                for doc, text, latin in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), latin_texts(batch.column("text")), strict=True):
                    ids = encode(text or "", latin) + end
                    for p, i in enumerate(range(0, len(ids), width)):
                        part = ids[i : i + width]
                        for c, x in zip(rows, (doc, p, i // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cluster.frugal(cut), PIECES)


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a length) and their sequence_id and offset.

    ``items`` is read twice and must be written, not recomputed. Items of a length are
    ranked in salted groups, whose sizes are summed up first, so that a length that most
    items share is no one task's.
    """
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    salts = LEAST_SALTS
    while salts * GROUP_ROWS < max(counts.values(), default=0):
        salts *= 2
    key = [c for c in items.columns if c != "length"]
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy(*key)
    ranked = salted.withColumn("_in", F.row_number().over(within) - 1).join(first, ["length", "_salt"]).select(*items.columns, (F.col("_first") + F.col("_in")).alias("_rank"))
    shipped = items.sparkSession.sparkContext.broadcast(table)
    schema = StructType(list(items.schema.fields)).add("sequence_id", "long").add("offset", "long")
    names = items.columns

    def seat(batches):
        t = shipped.value
        for batch in batches:
            n, r = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(t["key"], (n << 44) + r, "right") - 1
            d = r - (t["key"][k] - (n << 44))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(t["base"][k] + d // t["each"][k]), pa.array(t["at"][k] + d % t["each"][k] * n)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(cluster.frugal(seat), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens; repeated rows are packed each in its own place."""
    return place(cluster.materialise(pieces(docs, tokenizer, capacity)), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cluster.table(spark, sf_dir, "documents"))
