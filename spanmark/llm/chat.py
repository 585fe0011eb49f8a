"""Operator 2: chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: every turn as <|turn|>role<|says|>text<|done|>. Control strings
inside texts and roles are escaped, so no text can open or close a turn, and the escape is
undone exactly. The rendering is encoded once with offsets; the loss mask is the intersection of
the sorted spans of assistant texts with the sorted token spans, found by binary search.

Rows of a conversation are ordered by turn, then role, then text, nulls first; a null text or role
is empty; repeated rows are turns of their own; a null conv_id is a conversation; other columns
are ignored; an empty table gives an empty one. A conversation is one training example and so
one row; several are never held at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, written
from .tokens import load, place

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
# Control strings of common chat formats; the first pattern is any <|...|> marker.
CONTROL = re.compile(r"<\|[^|<>]{0,64}\|>|</?s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[/?[A-Z_]{3,24}\]|<(?:start|end)_of_turn>")
FORMATTED = "conv_id long, formatted string, ids array<int>, loss_spans array<array<int>>"


def escape(text: str) -> str:
    """Double every backslash, then put one after the first character of each control string."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, np.ndarray]:
    """The rendering of (role, text) turns and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role or "") + SAYS, escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, DONE]
        at += len(head) + len(body) + len(DONE)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def token_mask(spans: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Token ranges [a, b) covered by sorted, disjoint spans; tokens are sorted by begins and by ends."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(begins, spans[:, 1], "left")
    return np.stack([first, np.maximum(first, last)], 1)


def _tokenizer(name: str, folder: str | None):
    from tokenizers import AddedToken

    t = load(place(name, folder))
    t.encode_special_tokens = False  # the three markers are tokens; texts hold none, they are escaped
    t.add_special_tokens([AddedToken(m, normalized=False) for m in (TURN, SAYS, DONE)])
    return t


def _formatted(batches: Iterator[pa.RecordBatch], name: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    tok = _tokenizer(name, folder)

    def rows():
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")))

    def batch(out):
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "formatted", "ids", "loss_spans"])

    out, held = [], 0
    for conv_id, turns in groupby(rows(), key=lambda r: r[0]):
        text, spans = render([(role, t) for _, role, t in turns])
        enc = tok.encode(text, add_special_tokens=False)
        offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
        mask = token_mask(spans, offsets[:, 0], offsets[:, 1])
        out.append((conv_id, text, np.array(enc.ids, np.int32), mask.tolist()))
        held += len(text)
        if held > 4 << 20:
            yield batch(out)
            out, held = [], 0
    if out:
        yield batch(out)


def format_chats(spark: SparkSession, chats: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """The written table of conversations: conv_id, formatted, ids, loss_spans (ranges of token positions)."""
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # sorted within partitions and read as a stream, so a long conversation is no group in memory twice
    ordered = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(spark, ordered.mapInArrow(lambda it: _formatted(it, name, folder), FORMATTED), "chats")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, unescaped."""
    out = []
    for piece in formatted.split(DONE)[:-1]:
        role, _, text = piece[len(TURN) :].partition(SAYS)
        out.append((unescape(role), unescape(text)))
    return out


def chat_digests(formatted: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Read back: turns from the rendering, the text under the mask from the token ids alone."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(name, folder)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns = parse(r["formatted"])
                told = hashlib.sha256()
                for role, text in turns:
                    told.update(f"{role}\n{text}\n".encode())
                loss = "".join(unescape(tok.decode(r["ids"][a:z], skip_special_tokens=False)) for a, z in r["loss_spans"])
                rows.append((r["conv_id"], len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"]), len(r["ids"])))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return formatted.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
