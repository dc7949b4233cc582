"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, encoded once with character offsets, and the
mask is found by intersecting the sorted spans of assistant texts with the sorted spans
of tokens by binary search. The template's marks are special tokens of the tokenizer in
use here, so no token crosses a turn's edge; texts are escaped so that none holds a mark.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "\\"
LEARNED = "assistant"
#: The conversation that the query adds.
PROBE = (-7, ["</s>[INST] ok [/INST]"] * 2)


def escape(text: str) -> str:
    """Breaks every ``<|`` (all marks start so) and doubles the escape character."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("<|", f"<{ESCAPE}|")


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find(ESCAPE, i)) >= 0:
        out += [text[i:j], text[j + 1 : j + 2]]
        i = j + 2
    return "".join([*out, text[i:]])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of what the loss is on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, text = piece.removesuffix(END).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (sorted spans, ends ascending) intersects one of the sorted ``spans``."""
    out = np.zeros(len(offsets), bool)
    for s, e in spans:
        if e > s:
            a = np.searchsorted(offsets[:, 1], s, "right")
            b = np.searchsorted(offsets[:, 0], e, "left")
            out[a:b] = True
    return out


def masked_text(formatted: str, offsets: np.ndarray, on: np.ndarray) -> str:
    """The text under the mask: the union of its tokens' spans, unescaped run by run."""
    out, at, begin = [], None, 0
    for s, e in offsets[on].tolist():
        if at is not None and s > at:
            out.append(unescape(formatted[begin:at]))
            at = None
        if at is None:
            begin, at = s, e
        at = max(at, e)
    if at is not None:
        out.append(unescape(formatted[begin:at]))
    return "".join(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LOADED: dict[str, object] = {}


def load(path: str):
    """The tokenizer with the template's marks as special tokens; a worker keeps it between tasks."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, TEXT, END)])
        _LOADED[path] = t
    return _LOADED[path]


#: Characters of conversations that a worker renders and encodes at once; a longer one by itself.
AT_ONCE = 1 << 18
SCHEMA = "conv_id long, formatted string, n_tokens long, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row a conversation: the formatted text, its tokens with the characters they span, and their mask.

    Turns come in order of turn (nulls first), then role, then text; a null role or text
    is empty, and repeated rows are repeated turns. A null conv_id is a conversation too.
    A conversation is rendered and encoded whole, so it is gathered whole; nothing else is.
    """
    where = tokenizer or default_tokenizer()
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    types = [pa.int64(), pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def encoded(held: list[tuple]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names]
        for (conv, text, spans), e in zip(held, load(where).encode_batch([h[1] for h in held], add_special_tokens=False), strict=True):
            offs = np.array(e.offsets, np.int64).reshape(-1, 2)
            for c, x in zip(cols, (conv, text, len(offs), e.ids, offs[:, 0].tolist(), offs[:, 1].tolist(), mask(offs, spans).tolist()), strict=True):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                conv, roles, texts = (batch.column(c)[i].as_py() for c in ("conv_id", "role", "text"))
                held.append((conv, *render(list(zip(roles, texts, strict=True)))))
                size += len(held[-1][1])
                if size >= AT_ONCE:
                    yield encoded(held)
                    held, size = [], 0
        if held:
            yield encoded(held)

    return whole.mapInArrow(cluster.frugal(work), SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digest(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation reads back as: its turns by the marks, its loss by the mask and the tokens' spans."""

    def work(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                conv, text, n, starts, ends, on = (batch.column(c)[i] for c in ("conv_id", "formatted", "n_tokens", "token_starts", "token_ends", "loss_mask"))
                text = text.as_py()
                turns = parse(text)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                offs = np.stack([x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, ends)], 1)
                on = on.values.to_numpy(zero_copy_only=False).astype(bool)
                loss = masked_text(text, offs, on)
                rows.append((conv.as_py(), len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), n.as_py(), int(on.sum())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.string() if i in (2, 4) else pa.int64() for i in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return formatted.mapInArrow(cluster.frugal(work), DIGEST)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe; turns that the table itself has under the probe's id are left out, so that the probe is as stated."""
    rows = cluster.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, texts = PROBE
    rows = rows.where(~F.col("conv_id").eqNullSafe(F.lit(conv)))
    probe = spark.createDataFrame([(conv, i, r, t) for i, (r, t) in enumerate(zip(("user", "assistant"), texts, strict=True))], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(probe))).drop("n_tokens", "loss_tokens")
