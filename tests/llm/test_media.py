"""Media columns: stored bytes, tensors read back against a plain computation of each step."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanmark.llm.media import BANDS, FRAME, FRAMES, HOP, LOW_RATE, RATE, _filter, features, from_stream, from_wav, log_mel, media_digests, resample, segments, tensors, to_stream, to_wav, write_features, write_media

TEXTS = [None, "", "é" * 40, "a" * 64, "long text " * 9000, "a" * 64, "The quick, brown fox; " * 70]


def padded(text):
    data = (text or "").encode()
    return data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))


def plain_resampled(x, up, down):
    """Zeros between samples, the whole filter, every down-th sample."""
    h = _filter(up, down).astype(float)
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    full = np.convolve(spread, h)[len(h) // 2 :]
    return full[: -(-len(x) * up // down) * down : down][: -(-len(x) * up // down)]


def plain_log_mel(x):
    """Each frame's discrete Fourier transform by its definition, each band's triangle by its corners."""
    corners = [700 * (10 ** (2595 * np.log10(1 + LOW_RATE / 2 / 700) * k / (BANDS + 1) / 2595) - 1) * FRAME / LOW_RATE for k in range(BANDS + 2)]
    f = np.arange(FRAME // 2 + 1)
    turn = np.exp(-2j * np.pi * np.outer(f, np.arange(FRAME)) / FRAME)
    out, at = [], 0
    while not out or at + FRAME < len(x) + HOP:
        part = np.zeros(FRAME)
        part[: len(x[at : at + FRAME])] = x[at : at + FRAME]
        power = np.abs(turn @ (part * np.hanning(FRAME))) ** 2
        bands = [sum(p * max(0, min((k - a) / (b - a), (c - k) / (c - b))) for k, p in zip(f, power)) for a, b, c in zip(corners, corners[1:], corners[2:])]
        out.append(np.log10(np.array(bands) + 1e-6))
        at += HOP
    return np.array(out)


def plain_segments(energy, high=1.0, low=-1.0):
    mid, on, out = np.median(energy), False, []
    for k, e in enumerate(energy):
        if e >= mid + high and not on:
            on, _ = True, out.append([k, len(energy)])
        elif e < mid + low and on:
            on, out[-1][1] = False, k
    return out


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.createDataFrame([(i if i != 6 else None, t, "m", b"t") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string, tensors binary")
    return write_features(spark, write_media(spark, df)).cache()


def test_stored_bytes(spark, stored):
    got = {r["doc_id"]: r for r in media_digests(stored).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data, full, r = (t or "").encode(), padded(t), got[i if i != 6 else None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r["media_bytes"] == len(to_wav(data)) and r["media_sha256"] == hashlib.sha256(to_wav(data)).hexdigest() and from_wav(to_wav(data)) == full
    assert tuple(got[3])[1:] == tuple(got[5])[1:] and got[0]["feature"] == got[1]["feature"] != got[2]["feature"]
    assert len({r["feature"] for r in got.values()}) == 5
    none = spark.createDataFrame([], "doc_id long, text string")
    assert media_digests(write_features(spark, write_media(spark, none))).collect() == []


def test_stored_tensors_equal_a_plain_computation(stored):
    rows = {}
    for r in tensors(stored).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    segmented = {r["doc_id"]: r["segments"] for r in stored.collect()}
    up, down = 3, 4
    assert (LOW_RATE * down, LOW_RATE % up) == (RATE * up, 0)
    for i in (0, 2, 3, 6):
        x = plain_resampled((np.frombuffer(padded(TEXTS[i]), np.uint8) - 128.0) / 128, up, down)
        mel, key = plain_log_mel(x), i if i != 6 else None
        got = sorted(rows[key], key=lambda r: r["k"])
        assert [r["k"] for r in got] == list(range(-(-len(mel) // FRAMES)))
        values = np.array([r["tensor"] for r in got]).reshape(-1, BANDS)
        assert np.abs(values[: len(mel)] - mel).max() < 0.01 and (values[len(mel) :] == -6).all()
        seconds = len(padded(TEXTS[i])) / RATE
        step = FRAMES * HOP / LOW_RATE
        assert np.allclose([[r["begin"], r["end"]] for r in got], [[k * step, min(seconds, (k + 1) * step)] for k in range(len(got))])
        energy = log_mel(resample(((np.frombuffer(padded(TEXTS[i]), np.uint8).astype(np.float32)) - 128) / 128, up, down))[1]
        assert np.allclose(np.array(segmented[key]).reshape(-1, 2), np.array([[a * HOP / LOW_RATE, min(seconds, b * HOP / LOW_RATE)] for a, b in plain_segments(energy)]).reshape(-1, 2))
    assert len(rows[4]) == features(padded(TEXTS[4]))[0].num_rows > 10


def test_each_step_on_noise():
    rng = np.random.default_rng(5)
    x = rng.normal(size=3000).astype(np.float32)
    for up, down in ((3, 4), (1, 2), (5, 3), (1, 1)):
        assert np.allclose(resample(x, up, down), plain_resampled(x, up, down), atol=1e-4)
    for _ in range(200):
        energy = np.round(rng.normal(size=rng.integers(1, 40)) * 2, 1)
        assert segments(energy).tolist() == plain_segments(energy)
    t = np.sin(2 * np.pi * 0.01 * np.arange(4000)).astype(np.float32)
    y = resample(t, 3, 4)
    assert np.abs(y[100:-100] - np.sin(2 * np.pi * 0.01 * np.arange(len(y)) * 4 / 3)[100:-100]).max() < 0.1


def test_streams_say_their_shape():
    found, _ = features(padded("some words " * 3000))
    values, begin, end = from_stream(to_stream(found))
    assert values.shape == (found.num_rows, FRAMES, BANDS) and values.dtype == np.float16 and (begin < end).all()
    with pa.ipc.open_stream(to_stream(found)) as stream:
        assert isinstance(stream.schema.field("tensor").type, pa.FixedShapeTensorType)
    other = pa.BufferOutputStream()
    with pa.ipc.new_stream(other, pa.schema([("tensor", pa.int8())])):
        pass
    with pytest.raises(ValueError):
        from_stream(other.getvalue().to_pybytes())
