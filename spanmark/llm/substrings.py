"""Operator 3: removal of word windows that repeat anywhere, by FM-index shards.

A window's minimiser is its run of GRAM words with the least code; equal windows have equal
minimisers at equal places. Counting minimisers (one for some 14 words) tells which windows can
repeat at all. These are cut into segments, runs of windows with one minimiser, and sharded by
it, so that equal windows always meet in a shard. Each shard indexes its distinct segments (with
how often each occurs) in a compressed FM-index, streams them through backward search, and
reports the intervals of windows that occur more than once. A minimiser that is very frequent
is cut into single windows, sharded by the whole window, so no shard grows with it.

A window whose words also start anywhere else, in the same document or another, goes with all its words.
Null text has no words; shorter texts than a window lose nothing; repeated rows are copies
and lose what they share; a null doc_id is kept; other columns are ignored; an empty table gives
an empty one. Words are known by 64-bit codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bitmap_of, grams, mix, passing, range_codes, release, runs_of, scratch, slices, trimmed, without, word_codes, written
from .fm_index import FMIndex

GRAM = 8
HOT = 20_000
SHARD_WORDS = 100_000
BATCH_WORDS = 1 << 18  # a segment has under two windows of words, however long its text
BASE = "doc_id long, text_code long, n_words long, whole_sha256 string, minimisers array<long>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes.split cuts at x09-x0D and x20


class Windows:
    """The windows of some texts: their text, their start in it, and the value and place of their minimiser."""

    def __init__(self, texts: pa.Array, window: int):
        self.codes, self.ends = word_codes(texts)
        gram = min(GRAM, window)
        g = runs_of(self.codes, gram) if gram == GRAM else grams(self.codes, gram)
        span = window - gram + 1
        # the leftmost least of each `span` runs: by the upper half of the code, then by place; minima over doubled widths
        key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        width, m = 1, len(g) - span + 1
        while width * 2 <= span and len(key) > width:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if m > 0 and width < span:
            key = np.minimum(key[:m], key[span - width : span - width + m])
        at = (key[: max(m, 0)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = np.diff(self.ends)
        # windows that lie within one text
        count = np.maximum(size - window + 1, 0)
        self.text = np.repeat(np.arange(len(size)), count)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count) + self.ends[:-1][self.text]
        self.start = self.place - self.ends[:-1][self.text]
        self.at = at[self.place]
        self.value = g[self.at]

    def new(self) -> np.ndarray:
        """Where a window's minimiser stands elsewhere than the last one's, or in another text."""
        same = (self.at[1:] == self.at[:-1]) & (self.text[1:] == self.text[:-1])
        return np.r_[True, ~same] if len(self.at) else np.empty(0, bool)


def _lists(text: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """values, sorted by text, as a list for each of n texts."""
    ends = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _base(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices(batch)):
        w = Windows(b["text"], window)
        first = w.new()
        sha = [hashlib.sha256(b" ".join(words_of(t.as_py()))).hexdigest() for t in b["text"]]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_code"], pa.array(np.diff(w.ends).astype(np.int64)), pa.array(sha, pa.string()), _lists(w.text[first], w.value[first], b.num_rows)], names=["doc_id", "text_code", "n_words", "whole_sha256", "minimisers"])


def _listed(lists: pa.Array, w: Windows) -> np.ndarray:
    """Which windows' minimisers are in their text's list."""
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    value = np.asarray(lists.flatten()).view(np.uint64)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keys, code = np.unique(np.r_[value, w.value], return_inverse=True)
    have = row * (len(keys) + 1) + code[: len(value)]
    want = w.text * (len(keys) + 1) + code[len(value) :]
    return np.isin(want, have)


def _segments(batches: Iterator[pa.RecordBatch], window: int, with_codes: bool) -> Iterator[pa.RecordBatch]:
    """Segments of rows (uid, text, wanted: minimisers that repeat, frequent: those cut into windows).

    Without codes: uid, start, windows, h1, h2. With codes: shard key, h1, h2, codes."""
    for b in (x for batch in batches for x in slices(batch)):
        w = Windows(b["text"], window)
        hot = _listed(b["frequent"], w)
        first = np.flatnonzero(w.new() | hot)
        m = np.diff(np.r_[first, len(w.at)])
        use = _listed(b["wanted"], w)[first]
        first, m = first[use], m[use]
        begin, end = w.place[first], w.place[first] + m + window - 1
        h1 = range_codes(w.codes, begin, end).view(np.int64)
        h2 = range_codes(mix(w.codes ^ np.uint64(0x452821E638D01377)), begin, end).view(np.int64)
        if with_codes:
            key = np.where(hot[first], h1, w.value[first].view(np.int64))
            ends = np.r_[0, np.cumsum(end - begin)]
            at = 0
            while at < len(begin):  # so many segments at a time that their words stay under BATCH_WORDS
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_WORDS, "right")) - 1)
                offsets = ends[at : to + 1] - ends[at]
                flat = w.codes[np.repeat(begin[at:to] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])]
                codes = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(key[at:to]), pa.array(h1[at:to]), pa.array(h2[at:to]), codes], names=["key", "h1", "h2", "codes"])
                at = to
        else:
            uid = np.asarray(b["uid"])[w.text[first]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (uid, w.start[first], m, h1, h2)], names=["uid", "start", "windows", "h1", "h2"])


def repeated_runs(sequences: list[np.ndarray], weight: np.ndarray, window: int) -> list[np.ndarray]:
    """For each sequence of a shard the intervals [a, b) of window starts that occur more than once."""
    counts = FMIndex(sequences, window).window_counts(sequences)
    out = []
    for n, w in zip(counts, weight):
        on = (n > 1) | (w > 1)
        out.append(np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0])))
    return out


def _shard(window: int):
    def index(rows: pd.DataFrame) -> pd.DataFrame:
        runs = repeated_runs([np.frombuffer(c, np.uint64) for c in rows["codes"]], rows["weight"].to_numpy(), window)
        out = pd.DataFrame({"h1": rows["h1"], "h2": rows["h2"], "runs": [r.astype(np.int32).tolist() for r in runs]})
        out = out[[len(r) > 0 for r in runs]]
        release()
        return out

    return index


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices(batch)):
        out = []
        for doc_id, t, runs in zip(b["doc_id"].to_pylist(), b["text"], b["runs"]):
            words = words_of(t.as_py())
            edge = np.zeros(len(words) + 1, np.int64)
            pair = np.asarray(runs.values).reshape(-1, 2)
            np.add.at(edge, pair[:, 0], 1)
            np.add.at(edge, pair[:, 1] + window - 1, -1)  # the last window start before b reaches b + window - 2
            stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
            text = b" ".join([words[i] for i in stay.tolist()])
            out.append((doc_id, len(words), len(words) - len(stay), hashlib.sha256(text).hexdigest(), text.decode()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), b["rest"]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "rest"])


class Repeats:
    """What was found: `base`, a row for each document, and `changed`, the documents that lose words, with what is kept."""

    def __init__(self, base: DataFrame, changed: DataFrame, affected: DataFrame):
        self.base, self.changed, self.affected = base, changed, affected

    def digests(self) -> DataFrame:
        """Per document: doc_id, n_words, n_removed, kept_sha256."""
        b, a = self.base.alias("b"), self.affected.alias("a")
        same = b.join(a, F.expr("b.doc_id <=> a.doc_id and b.text_code = a.text_code"), "left_anti")
        same = same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"))
        return same.union(self.changed.select("doc_id", "n_words", "n_removed", "kept_sha256"))


def find_repeats(spark: SparkSession, docs: DataFrame, window: int = 35, hot: int = HOT, shard_words: int = SHARD_WORDS, carried: tuple[str, ...] = ()) -> Repeats:
    """Find what repeats in docs (doc_id, text); the columns `carried` come with the changed documents, in `rest`."""
    with scratch(spark, "minimisers", "wanted", "picked", "removed"):
        return _found(spark, docs, window, hot, shard_words, carried)


def _found(spark: SparkSession, docs: DataFrame, window: int, hot: int, shard_words: int, carried: tuple[str, ...]) -> Repeats:
    rest = F.struct(*(F.lit(None).cast("int").alias(c) if c == "text" else F.col(c) for c in carried)) if carried else F.struct(F.lit(None).cast("int").alias("none"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest")).select("*", F.xxhash64("text").alias("text_code"))
    base = docs.select("doc_id", "text", "text_code").mapInArrow(lambda it: trimmed(_base(it, window)), BASE)
    base = written(spark, base.select(F.monotonically_increasing_id().alias("rid"), "*"), "minimisers")
    often = base.select(F.explode("minimisers").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = written(spark, often, "repeated-minimisers")
    own = base.groupBy("doc_id", "text_code").agg(F.min("rid").alias("uid"))
    one = base.select(F.col("rid").alias("uid"), "doc_id", "text_code", "minimisers").join(own.select("uid"), "uid", "left_semi")
    some = one.select("uid", F.explode(F.array_distinct("minimisers")).alias("m")).join(often, "m")
    lists = some.groupBy("uid").agg(F.collect_set("m").alias("wanted"), F.collect_set(F.when(F.col("n") > hot, F.col("m"))).alias("frequent"))
    wanted = written(spark, lists.join(one.select("uid", "doc_id", "text_code"), "uid"), "wanted")
    bitmap = bitmap_of(wanted, "text_code")
    d, w = docs.mapInArrow(passing(bitmap, "text_code"), docs.schema).alias("d"), wanted.alias("w")
    picked = d.join(w, F.expr("d.doc_id <=> w.doc_id and d.text_code = w.text_code")).select("uid", "d.doc_id", "d.text_code", "text", "rest", "wanted", "frequent")
    picked = written(spark, picked, "picked", "zstd")

    use = picked.select("uid", "text", "wanted", "frequent")
    coded = use.mapInArrow(lambda it: trimmed(_segments(it, window, True)), "key long, h1 long, h2 long, codes binary")
    distinct = coded.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("weight"), F.first("codes").alias("codes"))
    distinct = written(spark, distinct, "segments")
    total = distinct.agg(F.sum(F.octet_length("codes")) / 8).first()[0] or 0
    shards = max(1, int(total / shard_words))
    sharded = distinct.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "h1", "h2", "weight", "codes")
    runs = written(spark, sharded.groupBy("shard").applyInPandas(_shard(window), "h1 long, h2 long, runs array<int>"), "runs")
    placed = use.mapInArrow(lambda it: trimmed(_segments(it, window, False)), "uid long, start long, windows long, h1 long, h2 long").join(runs, ["h1", "h2"])
    per = placed.select("uid", F.transform("runs", lambda r: r + F.col("start")).alias("runs")).groupBy("uid").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    per = written(spark, per, "removed")
    schema = StructType([StructField(n, t) for n, t in zip(("doc_id", "n_words", "n_removed", "kept_sha256", "kept"), (LongType(), LongType(), LongType(), StringType(), StringType()))] + [picked.schema["rest"]])
    changed = picked.join(per, "uid").select("doc_id", "text", "rest", "runs").mapInArrow(lambda it: trimmed(_kept(it, window)), schema)
    return Repeats(base, changed, wanted.join(per.select("uid"), "uid").select("doc_id", "text_code"))


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = 35) -> DataFrame:
    """docs with the repeated words removed: changed texts are their kept words joined by one space, others stay as they are."""
    with scratch(spark, "wanted", "picked", "removed"):  # the table of all documents' minimisers is not used
        found = find_repeats(spark, docs, window, carried=tuple(docs.columns))
    new = found.changed.select(*(F.col("kept").alias(c) if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
    return without(docs, found.affected).union(new)
