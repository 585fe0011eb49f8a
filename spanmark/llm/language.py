"""Operator 8: language ID by sparse multinomial logistic regression on character n-grams.

Features are hashed character n-grams of the whole lower-cased text, sublinear TF times IDF,
L2-normalised. IDF counts every training document. The regression is fitted by
follow-the-regularised-leader (proximal, per coordinate) with an elastic net on a bounded sample
of labelled rows, and a temperature is chosen on a part of the sample held back for it.

Null text, or one without a letter: "und", score 0. A null lang is no label; a null doc_id is never
learnt from and not held out; repeated rows count and are answered row by row; other columns are
ignored; without any label all is "und"; an empty table gives an empty one. More than MOST_LANGS distinct
langs are an error: what the model takes on the driver and in each task grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed

BITS = 15
DIMS = 1 << BITS
CHUNK = 1 << 20
UND = "und"
MOST_LANGS = 500
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L); digits and numbers in other forms are none."""
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram occurs in a text; a chunk at a time, grams over the cuts included."""
    text, out = text.lower(), np.zeros(DIMS, np.int64)
    for at in range(0, max(len(text), 1), CHUNK):
        c = np.frombuffer(text[max(0, at - 2) : at + CHUNK].encode("utf-32-le"), np.uint32)
        new = min(at, 2)  # characters seen before: grams that end in them are counted
        h = np.zeros(len(c), np.uint32)
        for n in range(3):
            h = (h[:-1] if n else h) * _ODD[n] + c[n:] + np.uint32(n + 1)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out += np.bincount((mixed >> np.uint32(32 - BITS))[max(0, new - n) :], minlength=DIMS)
    return out


def weighed(tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the normalised TF-IDF vector."""
    at = np.flatnonzero(tf)
    value = (1 + np.log(tf[at])) * idf[at]
    return at, value / (np.sqrt((value * value).sum()) or 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> np.ndarray:
    """Weights (DIMS, k) by FTRL-proximal; l1 keeps them sparse, l2 small."""
    z, n = np.zeros((DIMS, k)), np.zeros((DIMS, k))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            w = weights(z[at], n[at])
            p = softmax(value @ w)
            p[y[i]] -= 1
            g = value[:, None] * p
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of a fixed grid with the least log loss."""
    grid = np.geomspace(0.05, 5, 80)
    if not len(y):
        return 1.0
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for text in b["text"]:
            df += counts(text.as_py() or "") > 0
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[df[at], n])], names=["gram", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"]):
            tf = counts(text.as_py() or "")
            at = np.flatnonzero(tf)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<u2").tobytes()]), pa.array([tf[at].astype("<u4").tobytes()])], names=["lang", "at", "tf"])


class Model:
    """Languages, IDF, weights and temperature; a few hundred KB a language whatever the corpus."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, t: float):
        self.langs, self.idf, self.weights, self.t = langs, idf.astype(np.float32), weights.astype(np.float32), t

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UND, 0.0
        at, value = weighed(counts(text), self.idf)
        p = softmax((value @ self.weights[at]).astype(np.float64) / self.t)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(spark: SparkSession, labelled: DataFrame, sample_rows: int = 2400) -> Model:
    """Fit on rows (doc_id, text, lang). The sample takes about sample_rows rows in all, as many of each
    language as far as there are; a row is at most 6 bytes x 32,768, whatever its text's length."""
    rows = labelled.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kinds = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(kinds) > MOST_LANGS:  # weights take 256 KB a language on the driver and in each task
        raise ValueError(f"more than {MOST_LANGS} distinct values of lang: these are no languages")
    per = {r["lang"]: r["n"] for r in kinds}
    langs = sorted(per)
    if not langs:
        return Model([], np.zeros(DIMS), np.zeros((DIMS, 0)), 1.0)
    counted = rows.select("text").mapInArrow(_document_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    df = {r["gram"]: r["n"] for r in counted.collect()}  # DIMS rows at most
    idf = np.full(DIMS, np.log(1 + df[-1]) + 1)
    for gram, n in df.items():
        if gram >= 0:
            idf[gram] = np.log((1 + df[-1]) / (1 + n)) + 1
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * (sample_rows / len(langs)) / per[lang])))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share).mapInArrow(_sampled, "lang string, at binary, tf binary").limit(2 * sample_rows + len(langs)).collect()
    picked.sort(key=lambda r: (r["lang"], r["at"], r["tf"]))
    data, y = [], []
    for r in picked:
        tf = np.zeros(DIMS)
        tf[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["tf"], "<u4")
        data.append(weighed(tf, idf))
        y.append(langs.index(r["lang"]))
    y = np.array(y, np.int64)
    held = np.arange(len(y)) % 5 == 0
    w = fit_ftrl([d for d, h in zip(data, held) if not h], y[~held], len(langs))
    logits = np.array([v @ w[at] for (at, v), h in zip(data, held) if h]).reshape(-1, len(langs))
    return Model(langs, idf, w, temperature(logits, y[held]))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs (doc_id by default) with the predicted language and its score, under `names`."""
    keep = keep or ["doc_id"]
    text = "text" if "text" in keep and dict(docs.dtypes)["text"] == "string" else "whole text"

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(t.as_py()) for t in b[text]]
            cols = [b[c] for c in keep] + [pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    rows = docs.select(*keep, *([] if text == "text" else [F.col("text").cast("string").alias(text)]))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(lambda it: trimmed(answers(it)), schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trainable(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from: doc_id given and crc32 of it mod 4 not 2."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def predict_languages(spark: SparkSession, docs: DataFrame, sample_rows: int = 2400) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train(spark, trainable(docs), sample_rows)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
