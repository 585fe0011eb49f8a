"""Operator 6: media columns with audio features.

A text's bytes, padded with 0 up to a positive multiple of 64, become 8-bit mono samples of a WAV
file, one binary column of a written table. The table is read again: samples are resampled at 3/4 of
their rate by a polyphase filter (three phases), turned into overlapped log-mel frames, and segmented by
energy with hysteresis. Features are written as a second table, in which each file has an Arrow stream
of tensors of one fixed shape (FRAMES x BANDS, float16) with their time spans; `tensors` gives a row
for each, and digests are taken from what that table holds.

Null text is empty; repeated rows are files of their own, equal texts have equal values; a null
doc_id is kept; other columns are ignored; an empty table gives an empty one. Frames are made a
block at a time, so a very long text needs little more than its own size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, written

RATE, LOW_RATE = 16_000, 12_000
FRAME, HOP, BANDS, FRAMES = 512, 256, 24, 16
UNIT = 64
MEDIA = "doc_id long, n_bytes long, media binary"
TOLD = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
FEATURES = TOLD + ", segments array<array<double>>, tensors binary"
TENSORS = "doc_id long, media_sha256 string, k long, begin double, end double, tensor array<float>"
KIND = pa.fixed_shape_tensor(pa.float16(), [FRAMES, BANDS])
SPANNED = pa.schema([("tensor", KIND), ("begin", pa.float64()), ("end", pa.float64())])


def to_wav(data: bytes) -> bytes:
    """data padded to a positive multiple of UNIT, as the samples of a WAV file."""
    payload = data + bytes(max(1, -(-len(data) // UNIT)) * UNIT - len(data))
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples, found by walking the chunks of the file."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


@cache
def _filter(up: int, down: int, half: int = 6) -> np.ndarray:
    most = max(up, down)
    t = np.arange(-half * most, half * most + 1)
    return (np.sinc(t / most) * np.hanning(len(t) + 2)[1:-1] * up / most).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down times its rate: each output takes the taps of its own phase only."""
    h = _filter(up, down)
    middle, n = len(h) // 2, -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    for r in range(up):  # outputs r, r + up, ...: they share a phase
        at = np.arange(r, n, up) * down + middle
        phase, last = int(at[0] % up) if len(at) else 0, at // up
        taps = h[phase::up]
        pad = np.concatenate([np.zeros(len(taps), np.float32), x, np.zeros(middle // up + 2, np.float32)])
        y = np.zeros(len(at), np.float32)
        begin, step = (int(last[0]) if len(at) else 0), down
        for j, tap in enumerate(taps):
            first = begin - j + len(taps)
            y += tap * pad[first : first + step * (len(at) - 1) + 1 : step]
        out[r::up] = y
    return out


@cache
def _mel() -> np.ndarray:
    top = 2595 * np.log10(1 + LOW_RATE / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1) * FRAME / LOW_RATE
    f = np.arange(FRAME // 2 + 1)
    rise = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32).T


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, BANDS) that overlap by half, and each frame's energy in dB."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, mel, energy = np.hanning(FRAME).astype(np.float32), [], []
    for at in range(0, n, 4096):
        block = frames[at : at + 4096]
        power = np.abs(np.fft.rfft(block * window, axis=1)).astype(np.float32) ** 2
        mel.append(np.log10(power @ _mel() + 1e-6))
        energy.append(10 * np.log10((block * block).mean(1) + 1e-9))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, high: float = 1.0, low: float = -1.0) -> np.ndarray:
    """Frame ranges [a, b): on from `high` dB above the median, off again below `low`."""
    mid = np.median(energy)
    mark = np.where(energy >= mid + high, 1, np.where(energy < mid + low, 0, -1))
    known = np.where(mark >= 0, np.arange(len(mark)), -1)
    known = np.maximum.accumulate(known)
    on = np.where(known >= 0, mark[known], 0)
    edge = np.flatnonzero(np.diff(np.r_[0, on, 0]))
    return edge.reshape(-1, 2)


def features(payload: bytes) -> tuple[pa.RecordBatch, list[list[float]]]:
    """Tensors with the time span of each, and the sounding segments, in seconds."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    common = gcd(RATE, LOW_RATE)
    mel, energy = log_mel(resample(x, LOW_RATE // common, RATE // common))
    n, step, seconds = len(mel), HOP / LOW_RATE, len(payload) / RATE
    count = -(-n // FRAMES)
    full = np.full((count * FRAMES, BANDS), -6, np.float16)  # -6: the floor of log_mel, silence
    full[:n] = mel
    begin = np.arange(count) * FRAMES * step
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * BANDS)
    columns = [pa.ExtensionArray.from_storage(KIND, flat), pa.array(begin), pa.array(np.minimum(seconds, begin + FRAMES * step))]
    return pa.RecordBatch.from_arrays(columns, schema=SPANNED), [[a * step, min(seconds, b * step)] for a, b in segments(energy).tolist()]


def to_stream(tensors: pa.RecordBatch) -> bytes:
    """Tensors and their time spans as an Arrow stream, which says their type and shape."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, SPANNED) as stream:
        stream.write_batch(tensors)
    return out.getvalue().to_pybytes()


def from_stream(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors (count, FRAMES, BANDS) and where each begins and ends, out of an Arrow stream of that shape."""
    with pa.ipc.open_stream(data) as stream:
        if stream.schema != SPANNED:
            raise ValueError(f"not a stream of {FRAMES} x {BANDS} tensors with spans: {stream.schema}")
        batch = stream.read_next_batch()
    return batch["tensor"].to_numpy_ndarray(), batch["begin"].to_numpy(), batch["end"].to_numpy()


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices(batch)):
        data = [(t.as_py() or "").encode() for t in b["text"]]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(d) for d in data], pa.int64()), pa.array(map(to_wav, data), pa.binary())], names=["doc_id", "n_bytes", "media"])


def write_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The written table of WAV files: doc_id, n_bytes, media."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(spark, rows.mapInArrow(_media, MEDIA), "media", "zstd")


def write_features(spark: SparkSession, media: DataFrame) -> DataFrame:
    """The written table of the stored files' digests, segments and tensors (an Arrow stream a file)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.float64())), pa.binary()]
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, "media", 2 << 20)):
            rows = []
            for doc_id, n, m in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist()):
                payload = from_wav(m)
                tensors, sounding = features(payload)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), sounding, to_stream(tensors)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return written(spark, media.mapInArrow(read, FEATURES), "features", "zstd")


def tensors(features_of: DataFrame) -> DataFrame:
    """A row for each tensor of the written table: its file, its number, its time span and its values, frame by frame."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, sha, data in zip(b["doc_id"], b["media_sha256"], b["tensors"].to_pylist()):
                values, begin, end = from_stream(data)
                flat = pa.array(values.reshape(-1).astype(np.float32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * (FRAMES * BANDS)), flat)
                yield pa.RecordBatch.from_arrays([pa.repeat(doc_id, len(values)), pa.repeat(sha, len(values)), pa.array(np.arange(len(values))), pa.array(begin), pa.array(end), lists], names=[c.split()[0] for c in TENSORS.split(", ")])

    return features_of.select("doc_id", "media_sha256", "tensors").mapInArrow(rows, TENSORS)


def media_digests(features_of: DataFrame) -> DataFrame:
    """Each row's stored tensors, their spans and its segments as one digest, beside the media's own."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, sounding in zip(b["tensors"].to_pylist(), b["segments"].to_pylist()):
                told = hashlib.sha256()
                for part in (*from_stream(data), np.array(sounding, float)):
                    told.update(np.ascontiguousarray(part).astype(part.dtype.newbyteorder("<")).tobytes())
                out.append(told.hexdigest())
            kept = [c.split()[0] for c in TOLD.split(", ")]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(out, pa.string())], names=[*kept, "feature"])

    return features_of.mapInArrow(digests, TOLD + ", feature string")
