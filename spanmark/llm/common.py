"""What the training-data operators share: tables in the shared folder, word splitting, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 19  # of text that a worker takes at a time: its arrays of words need some 30 times as much


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> str:
    """Arrow batches of BATCH_BYTES at most from here on, if the session doesn't have smaller ones; what it had."""
    own = spark.conf.get(BATCH_SETTING)
    size = int(own.rstrip("bB")) if own.rstrip("bB").lstrip("-").isdigit() else BATCH_BYTES + 1
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return own


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches for a while; the session's own setting comes back after."""
    own = bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, own)


SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written in this block are deleted when it is. Else they stay until the driver happens to collect
    its garbage, which can be after many more tables."""
    own = spark.conf.get(SHUFFLE_SETTING, None)
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_SETTING) if own is None else spark.conf.set(SHUFFLE_SETTING, own)


_OPEN: ContextVar[list[str] | None] = ContextVar("tables of the innermost open scratch block", default=None)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Tables written in this block are deleted at its end, but those named in `keep`, which an outer block then has.
    Nothing that outlives the block may read the deleted ones."""
    paths: list[str] = []
    before = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(before)
        for p in paths:
            if p.rpartition("/")[2].rpartition("-")[0] not in keep:
                there = spark._jvm.org.apache.hadoop.fs.Path(p)
                there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
            elif _OPEN.get() is not None:
                _OPEN.get().append(p)


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get() is not None:
        _OPEN.get().append(path)
    with small_batches(spark), own_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system. Workers are kept for later stages, in which JVM and Python share what there is."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(rows: Iterator) -> Iterator:
    """The rows of a task's function; when they end, freed memory goes back."""
    try:
        yield from rows
    finally:
        release()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


ROWS = 1 << 18  # of numbers to a task


def fewer(spark: SparkSession, df: DataFrame, rows: int, each: int = ROWS) -> DataFrame:
    """df in tasks of `each` rows, where a shuffle would make more of them than that. Rows that fit one task are
    grouped and joined without any shuffle."""
    tasks = max(1, -(-rows // each))
    return df.coalesce(tasks) if tasks < partitions(spark) else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n words, in order; empty if there are fewer."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + m])
    return out


def runs_of(codes: np.ndarray, n: int) -> np.ndarray:
    """As grams, for n a power of two, in log n passes."""
    out, width = codes, 1
    while width < n and len(out) > width:
        out = mix(out[:-width] * np.uint64(0x9E3779B97F4A7C15) + out[width:] + np.uint64(width))
        width *= 2
    return out if width == n else np.empty(0, np.uint64)


_ODD = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK_BYTES = 1 << 17


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, BLOCK_BYTES), base)])
    return _POWERS[0][:n], _POWERS[1][:n]


def range_codes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A code of values[begin:end] for each range, the same wherever the same values stand."""
    up, down = powers(len(values) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(values * down[1:])]
    return mix((sums[end] - sums[begin]) * up[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _byte_values(fold: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if fold:
        b[65:91] += np.uint64(32)
    return mix((b + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column of texts one after another, and where each begins and the last ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_codes(column, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words (cut at x09-x0D and x20) of all texts of an Arrow column, and where each text's
    begin and the last end. fold: A-Z count as a-z. The bytes are coded a block of words at a time."""
    data, offsets = text_bytes(column)
    inside = ~_WHITE[data]
    before, after = np.r_[False, inside[:-1]][: len(data)], np.r_[inside[1:], False][: len(data)]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK_BYTES, "right")))
        low = begin[at]
        out[at:to] = range_codes(_VALUES[fold][data[low : end[to - 1]]], begin[at:to] - low, end[at:to] - low)
        at = to
    return out, np.searchsorted(begin, offsets)


BITMAP = 1 << 23


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the keys' low bits: 1 MB whatever their number; when full it lets all pass."""
    low = F.col(column).bitwiseAND(F.lit(BITMAP - 1))
    words = keys.select(F.shiftright(low, 6).alias("at"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(BITMAP >> 6, np.int64)
    for r in words:
        out[r["at"]] = r["bits"]
    return out


def marked(bitmap: np.ndarray, codes) -> np.ndarray:
    """Whether the bits of codes are set."""
    at = np.asarray(codes) & np.int64(BITMAP - 1)
    return (bitmap[at >> 6] >> (at & 63) & 1).astype(bool)


def passing(bitmap: np.ndarray, column: str, on: bool = True):
    """For mapInArrow: the rows whose bit is set, or the others."""

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            yield b.take(pa.array(np.flatnonzero(marked(bitmap, b[column]) == on)))

    return lambda batches: trimmed(rows(batches))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, text_code). Only rows that share a bit with one of them are shuffled."""
    bitmap = bitmap_of(gone, "text_code")
    coded = docs.withColumn("code of the text", F.xxhash64(F.col("text").cast("string")))
    clear = coded.mapInArrow(passing(bitmap, "code of the text", False), coded.schema)
    maybe = coded.mapInArrow(passing(bitmap, "code of the text"), coded.schema).alias("m")
    stay = maybe.join(gone.alias("g"), (F.col("m.doc_id").cast("long").eqNullSafe(F.col("g.doc_id"))) & (F.col("m.code of the text") == F.col("g.text_code")), "left_anti")
    return clear.union(stay).drop("code of the text")


def slices(batch, column: str = "text", most: int = SLICE_BYTES):
    """Cut an Arrow batch so that each slice holds about `most` bytes of text, one row at least."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
