"""Operator 7: best-fit packing of documents into sequences by the sum-of-squares rule.

Each document is encoded and ended; longer ones are cut into full sequences with the remainder
first. Full pieces are sequences of their own. The others are spread over buckets by hash, so
every bucket sees the same mix of sizes, and each bucket packs its own: a piece goes where the
squared counts of open bins per residual gap sum up least. Bins that a bucket leaves too empty
are dissolved and packed again, in buckets of about PER_BUCKET pieces each time. The last round, in
which every bucket closes its bins as they are, is the one with a single bucket left, or the one
after a round that closed less than LEAST_CLOSED of its pieces: if pieces can't fill bins, all
buckets close theirs apart. No bucket grows with the corpus; pieces are dealt by row, so equal rows
are spread like others.

Null text is empty (its end id alone); rows with equal doc_id are documents of their own;
other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, trimmed, written
from .tokens import encoder

CAPACITY = 1024
PER_BUCKET = 20_000
ENCODED_BYTES = 1 << 20  # of text encoded together: the more, the fewer of its words are new
REMEMBERED = 200_000  # chunks of text in a generation: workers stay, and hold them for as long
FULL_ENOUGH, LEAST_CLOSED = 0.99, 0.25
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, rid long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens; only the first may be short."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def _pieces(batches: Iterator[pa.RecordBatch], name: str, folder: str | None, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(name, folder, REMEMBERED)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in (x for b in batches for x in slices(b, most=ENCODED_BYTES)):
        ids, offsets = enc.encode_many(batch["text"])
        raw = np.insert(ids, offsets[1:], end_id).astype("<u4").tobytes()
        rows, begin = [], 0
        for doc_id, n_ids in zip(batch["doc_id"].to_pylist(), (np.diff(offsets) + 1).tolist()):
            at = 0
            for k, n in enumerate(cut(n_ids, capacity)):
                rows.append((doc_id, k, at, n, zlib.crc32(raw[4 * (begin + at) : 4 * (begin + at + n)])))
                at += n
            begin += n_ids
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, in the order given.

    With N(g) open bins of gap g, moving one bin from gap g to g - s changes the sum of N squared
    by 2 (N(g - s) - N(g) + 1), one filled up by 1 - 2 N(g), and a new bin by 2 N(capacity - s) + 1.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        change = 2 * (count[: capacity - s + 1] - count[s:] + 1)  # by the gap that is left
        change[0] -= 2 * count[0] + 1
        change[count[s:] == 0] = 1 << 40
        left = int(change.argmin())
        if s < capacity and (change[left] >= 1 << 40 or 2 * count[capacity - s] + 1 < change[left]) or s >= capacity:
            b, bins, left = bins, bins + 1, capacity - s
        else:
            b = open_bins[left + s].pop()
            count[left + s] -= 1
        if left:
            open_bins[left].append(b)
            count[left] += 1
        out[i] = b
    return out


def _pack(level: int, last: bool, capacity: int):
    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "rid"], ascending=[False, True, True, True, True], kind="stable")
        size = rows["length"].to_numpy()
        bins = sum_of_squares(size, capacity)
        order = np.argsort(bins, kind="stable")
        rows, bins, size = rows.iloc[order], bins[order], size[order]
        ends = np.cumsum(size)
        first = np.r_[True, bins[1:] != bins[:-1]] if len(bins) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(first, ends - size, 0))
        fill = np.bincount(bins, size, minlength=1)[bins]
        kept = last | (fill >= FULL_ENOUGH * capacity)
        own = (level << 58) | (int(rows["bucket"].iloc[0]) << 26)
        return rows.assign(sequence_id=np.where(kept, own + bins, -1), offset=np.where(kept, ends - size - begin, -1))[["doc_id", "piece", "start", "length", "ids_crc32", "rid", "sequence_id", "offset"]]

    return bucket


def pieces(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with their start, length and checksum of ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: trimmed(_pieces(it, name, folder, end_id, capacity)), PIECES)


def pack_documents(spark: SparkSession, docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = written(spark, pieces(docs, name, folder, end_id, capacity).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    # a number that no two full pieces share and no packed sequence has: negative, by row
    parts = [table.where(whole).select("*", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo, level, last = table.where(~whole), 0, False
    n = todo.count()
    while True:
        buckets = max(1, math.ceil(n / PER_BUCKET))
        last = last or buckets == 1
        spread = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(buckets)).cast("int")
        packed = todo.select(*table.columns, spread.alias("bucket")).groupBy("bucket").applyInPandas(_pack(level, last, capacity), PACKED)
        packed = written(spark, packed, f"packed-{level}")
        if last:
            parts.append(packed)
            break
        parts.append(packed.where("sequence_id >= 0"))
        todo = packed.where("sequence_id < 0").select(*table.columns)
        left = todo.count()
        n, level, last = left, level + 1, n - left < LEAST_CLOSED * n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("rid")
