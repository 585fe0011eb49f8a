"""Operator 5: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts, once, and written; a bounded sample of labelled rows is
binned and boosted on the driver; the trees are flattened into arrays and every row is scored by
vectorised traversal. Nothing but the text is an input of a score.

Null text counts as empty; empty texts are scored too; a null label or null doc_id is never learnt
from; a doc_id labelled both ways is not learnt from; repeated rows are scored row by row; other
columns are ignored; without labels every score is 0.5; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

_MARKS = b".,;:!?'\"()-"
_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white, 4 mark, 5 symbol, 6 not ASCII
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), _MARKS)):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 6
NAMES = ["log_chars", "log_words", "lower", "upper", "digit", "white", "mark", "symbol", "wide", "word_mean", "word_spread", "word_most", "short", "distinct", "top", "ends_symbol", "ends_mark", "alone", "shout", "lines", "line_words", "line_same", "line_stop", "entropy", "repeat", "changes"]


def statistics(text: str | None) -> list[float]:
    """The statistics NAMES of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(len(raw), 1)
    kinds = _CLASS[raw]
    share = np.bincount(kinds, minlength=7) / n
    changes = np.count_nonzero(kinds[1:] != kinds[:-1]) / n
    words = text.split()
    m = max(len(words), 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    last = np.frombuffer("".join([w[-1] for w in words]).encode("utf-32-le"), np.uint32)
    last = _CLASS[np.minimum(last, 255)]
    pairs = len(set(zip(words, words[1:])))
    shout = sum(w.isupper() and len(w) > 1 for w in seen) / max(len(seen), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    p = np.bincount(raw, minlength=256) / n
    p = p[p > 0]
    return [
        np.log1p(len(text)), np.log1p(len(words)), *share.tolist(), float(size.mean()), float(size.std()), float(size.max()),
        float((size <= 3).mean()), len(seen) / m, max(seen.values(), default=0) / m,
        np.count_nonzero(last == 5) / m, np.count_nonzero(last == 4) / m, sum(c for w, c in seen.items() if not any(map(str.isalnum, w))) / m, shout,
        np.log1p(len(lines)), len(words) / k, 1 - len(set(lines)) / k, sum(x.rstrip()[-1] in ".!?" for x in lines) / k,
        float(-(p * np.log2(p)).sum()), 1 - pairs / max(len(words) - 1, 1), changes,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([statistics(t.as_py()) for t in b["text"]], np.float32).reshape(-1, len(NAMES))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], flat], names=["doc_id", "x"])


class Trees:
    """Complete binary trees of one depth as arrays: a feature and threshold a node, a value a leaf."""

    def __init__(self, base: float, depth: int, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray):
        self.base, self.depth, self.features, self.thresholds, self.leaves = base, depth, features, thresholds, leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 20) -> Trees:
    """Logistic boosting; splits are sought on histograms of gradients over quantile bins."""
    d, nodes = x.shape[1], (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Trees(base, depth, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    feats, thrs, vals = [], [], []
    offset = np.arange(d) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            key = ((at - first)[:, None] * (d * bins) + offset + binned).ravel()
            shape = (width, d, bins)
            hg, hh, hn = (np.bincount(key, np.repeat(w, d), minlength=width * d * bins).reshape(shape).cumsum(2) for w in (g, h, np.ones(len(y))))
            all_g, all_h, all_n = hg[:, :1, -1:], hh[:, :1, -1:], hn[:, :1, -1:]
            gain = hg**2 / (hh + l2) + (all_g - hg) ** 2 / (all_h - hh + l2) - all_g**2 / (all_h + l2)
            gain[(hn < least) | (all_n - hn < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - nodes
        value = -rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + l2)
        total += value[leaf]
        feats.append(feature), thrs.append(threshold), vals.append(value)
    return Trees(base, depth, np.array(feats), np.array(thrs), np.array(vals))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def measured(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The written table of doc_id and statistics x, a row for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(spark, rows.mapInArrow(_statistics, "doc_id long, x array<float>"), "statistics")


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = 40_000) -> Trees:
    """Fit on about sample_rows labelled rows, chosen by a hash of doc_id; all of them where there are fewer."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other").select("doc_id", "y")
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    rows = stats.join(known, "doc_id").select("doc_id", "y", "x").limit(2 * sample_rows).toPandas()  # 108 bytes a row
    if not len(rows):
        return boost(np.zeros((0, len(NAMES)), np.float32), np.zeros(0))
    rows = rows.assign(k=rows["x"].map(tuple)).sort_values(["doc_id", "k"])
    return boost(np.array(rows["x"].tolist(), np.float32), rows["y"].to_numpy().astype(float))


def score(stats: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score, predicted."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b["x"].flatten()).reshape(-1, len(NAMES))
            s = trees.score(x)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(scored, "doc_id long, score double, predicted int")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    stats = measured(spark, docs)
    return score(stats, train(stats, labels, sample_rows), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
