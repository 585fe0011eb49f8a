"""Operator 4: token ids of a corpus as patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id; each partition is one shard. A shard is
a run of segments, one table row each: the ids of some documents cut into blocks of 128. A
block keeps its minimum, the width that holds 90 % of its differences, the packed low bits, and
an exception list for the rest; an index of block starts lets a reader decode any block alone.

Null text is empty; null doc_id sorts first; rows with equal doc_id are ordered by text and
kept apart; other columns are ignored; an empty table gives no segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import encoder

BLOCK = 128
SEGMENT_BYTES = 4 << 20
SEGMENTS = "shard int, seq int, start long, n_ids long, n_docs int, doc_ids binary, doc_null binary, lengths binary, block_starts binary, payload binary"
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("n_exceptions", "u1")])


def _fold(rest: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each row's 128 values, one after another, as 16 w bytes a row."""
    columns = np.ascontiguousarray(rest.T).astype(np.uint64) & np.uint64((1 << w) - 1)
    words = np.zeros((2 * w, len(rest)), np.uint64)
    for j in range(BLOCK):
        k, b = divmod(j * w, 64)
        words[k] |= columns[j] << np.uint64(b)
        if b + w > 64:
            words[k + 1] |= columns[j] >> np.uint64(64 - b)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unfold(rows: np.ndarray, w: int) -> np.ndarray:
    """The inverse of _fold: 128 values a row."""
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view("<u8").T)
    columns = np.empty((BLOCK, len(rows)), np.uint64)
    for j in range(BLOCK):
        k, b = divmod(j * w, 64)
        columns[j] = words[k] >> np.uint64(b)
        if b + w > 64:
            columns[j] |= words[k + 1] << np.uint64(64 - b)
    return (columns & np.uint64((1 << w) - 1)).T.astype(np.uint32)


def pack(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """The payload of a run of ids (uint32), and where each block starts in it."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.empty(0, "<u4")
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    least = full.min(1)
    rest = full - least[:, None]
    k = int(percentile * BLOCK) - 1
    width = np.frexp(np.partition(rest, k, 1)[:, k].astype(np.float64))[1].astype(np.uint8)
    over = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    n_over = over.sum(1)
    head = np.zeros(n, HEAD)
    head["least"], head["width"], head["n_exceptions"] = least, width, n_over
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for i, row in zip(at.tolist(), _fold(rest[at], w) if w else ()):
            packed[i] = row.tobytes()
    heads, where = head.tobytes(), np.cumsum(n_over)
    row, col = np.nonzero(over)
    places, values = col.astype(np.uint8).tobytes(), rest[row, col].astype("<u4").tobytes()
    out, starts, at = [], np.empty(n, "<u4"), 0
    for i in range(n):
        a, b = (int(where[i - 1]) if i else 0), int(where[i])
        block = heads[i * HEAD.itemsize : (i + 1) * HEAD.itemsize] + packed[i] + places[a:b] + values[4 * a : 4 * b]
        starts[i] = at
        at += len(block)
        out.append(block)
    return b"".join(out), starts


def unpack(payload: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids (uint32) back from a payload and its block starts."""
    n = len(starts)
    raw = np.frombuffer(payload, np.uint8)
    starts = starts.astype(np.int64)
    if not n:
        return np.empty(0, np.uint32)
    head = raw[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD).reshape(n)
    full = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(head["width"]):
        at = np.flatnonzero(head["width"] == w)
        if w:
            full[at] = _unfold(raw[(starts[at] + HEAD.itemsize)[:, None] + np.arange(BLOCK * int(w) // 8)], int(w))
    for i in np.flatnonzero(head["n_exceptions"]):
        k, a = int(head["n_exceptions"][i]), int(starts[i]) + HEAD.itemsize + BLOCK * int(head["width"][i]) // 8
        full[i, raw[a : a + k]] = raw[a + k : a + 5 * k].copy().view("<u4")
    full += head["least"][:, None].astype(np.uint32)
    return full.reshape(-1)[:n_ids]


def _segments(batches: Iterator[pa.RecordBatch], name: str, folder: str | None, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, shard, seq, start = encoder(name, folder), TaskContext.get().partitionId(), 0, 0
    types = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), *((k, pa.binary()) for k in ("doc_ids", "doc_null", "lengths", "block_starts", "payload"))])
    for batch in batches:
        for part in slices(batch, most=SEGMENT_BYTES):
            ids, offsets = enc.encode_many(part["text"])
            ids = np.insert(ids, offsets[1:], end_id)
            payload, starts = pack(ids)
            doc_ids = part["doc_id"]
            cells = [shard, seq, start, len(ids), len(doc_ids), np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(doc_ids.is_null()).astype("u1").tobytes(), (np.diff(offsets) + 1).astype("<i8").tobytes(), starts.tobytes(), payload]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, types)], schema=types)
            seq, start = seq + 1, start + len(ids)


def write_ids(spark: SparkSession, docs: DataFrame, name: str = "word_bpe_49k.json", folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Encode docs (doc_id, text) and write them as segments; returns the written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return written(spark, ordered.mapInArrow(lambda it: _segments(it, name, folder, end_id), SEGMENTS), "token-ids")


def read_ids(segments: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: shard, start within its shard, doc_id, ids."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], np.frombuffer(r["block_starts"], "<u4"), r["n_ids"])
                lengths = np.frombuffer(r["lengths"], "<i8")
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                missing = np.frombuffer(r["doc_null"], "u1").astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), r["shard"], np.int32)),
                        pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=missing),
                        pa.array(r["start"] + ends - lengths),
                        pa.array(lengths.astype(np.int64)),
                        pa.array([zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                    ],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return segments.mapInArrow(docs, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document, for users of the files."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], np.frombuffer(r["block_starts"], "<u4"), r["n_ids"])
                offsets = np.concatenate([[0], np.cumsum(np.frombuffer(r["lengths"], "<i8"))]).astype(np.int32)
                missing = np.frombuffer(r["doc_null"], "u1").astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=missing), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return segments.mapInArrow(docs, "doc_id long, ids array<int>")


def token_digests(spark: SparkSession, docs: DataFrame, name: str = "word_bpe_49k.json", folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Only one total per shard comes to the driver, and there are as many shards as partitions.
    """
    segments = write_ids(spark, docs, name, folder, end_id)
    totals = sorted((r["shard"], r["n"]) for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, at = [], 0
    for shard, n in totals:
        base.append((shard, at))
        at += n
    bases = spark.createDataFrame(base, "shard int, base long")
    read = read_ids(segments).join(F.broadcast(bases), "shard")  # one row per shard
    return read.select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
