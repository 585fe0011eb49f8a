"""Operator 10: exact n-gram Jaccard join and its connected components.

Jaccard distance is a metric, so what is far from a pivot by another amount is far from each other.
Among unrelated documents all distances are near 1, and no pivot can part them; so the root
regions are cut first by an exact sieve: sets within the threshold differ in at most k shingles,
hence of k + 1 or more hash ranges of the shingles one is equal in both. Documents that share a
range's signature are a root region; equal regions are one. Then, region by region:

* its pivot is its best-connected member; regions with the same pivot make up the pivot's cell. Each
  member's distance to the pivot is computed exactly, and members within the threshold are linked
  to it. The pivot is then done, and so is a region whose members are all in one component.
* A region that is still large is joined again inside its pivot's cell. By the triangle inequality
  two linked members are both near the pivot or both far from it, if these two windows of distances
  overlap by k. The near ones are joined on their differences from the pivot, which differ in at
  most k shingles, too: either these share one of the k + 1 rarest shingles of each, and members that
  do are a region of the next round, or both lie so near that only a window of distances is left,
  which is one more region. The far ones are put through the sieve again with other hash ranges, once:
  a sieve can't part members that have most of a long passage in common. Whom it leaves in a large
  region again are from then on joined on their differences from the pivot, however far they are.
  Regions all of whose members are in one component are done.
* Small regions are joined member by member, where these are in different components and their sketches
  (counts by hash cell, whose L1 distance is a lower bound) don't rule a link out.

Equal sets are one node throughout. Distances are never estimated.

Null text and text without words: an empty set, linked with nothing. A null doc_id takes part, but
is no component's smallest id unless it has no other. Repeated rows are copies. Extra columns
are ignored. An empty table gives an empty one. Shingles are known by 64-bit codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_of, fewer, grams, marked, mix, partitions, passing, release, scratch, slices, trimmed, word_codes, written

LEAF_NODES = 256
SETS = "doc_id long, text_code long, code long, n long, h1 long, h2 long, sketch binary, wide binary"
PART_SIGNATURES = 400_000
PACKED_BYTES = 1 << 21  # of text whose signatures are packed together
CELLS, LONG = 256, 512
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct codes of the shingles of each whole text."""
    codes, ends = word_codes(texts, fold=True)
    runs = grams(codes, n)
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if z - a >= n:
            yield np.unique(runs[a : z - n + 1])
        elif z > a:  # the whole sequence as one, told apart from longer ones by its length
            yield grams(np.r_[codes[a:z], np.uint64(z - a)], z - a + 1)
        else:
            yield np.empty(0, np.uint64)


@cache
def size_classes(num: int, den: int) -> tuple[list[int], list[int], list[int]]:
    """Upper sizes of the classes, and for each the hash ranges and how many of them may be empty.

    Two sets of at most u shingles each with similarity num/den differ in k = 2u (den - num) / (den + num)
    at most. With k + 1 + s ranges, sets of which one has at most s empty ranges agree in one
    that is not empty; sets with more empty ranges are signed by these too.
    """
    ratio = min(0.75, num / den)
    uppers, ranges, slack = [], [], []
    u = 1
    while u < 1 << 40:
        k = 2 * u * (den - num) // (den + num)
        empty = k * np.exp(-u * ratio / max(k, 1))
        s = int(np.ceil(empty + 3 * np.sqrt(empty))) + 1 if k else 0
        uppers.append(u), ranges.append(k + 1 + s), slack.append(s)
        u = max(u + 1, int(u / ratio))
    return uppers, ranges, slack


def signatures(x: np.ndarray, num: int, den: int, seed: int = 0) -> np.ndarray:
    """Signatures of a set: one for each hash range of its size class, and of the next if partners may be there.
    Another seed puts the shingles into other ranges."""
    if seed:
        x = np.sort(mix(x ^ np.uint64(seed)))
    uppers, ranges, slack = size_classes(num, den)
    c = int(np.searchsorted(uppers, len(x)))
    sums = np.r_[np.uint64(0), np.cumsum(mix(x ^ _SEEDS[2]))]
    out = []
    for k in (c, c + 1) if len(x) * den // num > uppers[c] else (c,):
        b = ranges[k]
        if b == 1:  # no difference is possible: equal sets are one node already
            continue
        edge = np.searchsorted(((x >> np.uint64(32)) * np.uint64(b)) >> np.uint64(32), np.arange(b + 1))
        sig = mix(sums[edge[1:]] - sums[edge[:-1]] + mix(np.arange(b, dtype=np.uint64) + np.uint64(k << 40)))
        full = edge[1:] > edge[:-1]
        out.append(sig if b - np.count_nonzero(full) > slack[k] else sig[full])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices(batch)):
        size, h1, h2, told, more = [], [], [], [], []
        for x in shingles(b["text"], n):
            size.append(len(x))
            h1.append(mix(x ^ _SEEDS[0]).sum(dtype=np.uint64))
            h2.append(mix(x ^ _SEEDS[1]).sum(dtype=np.uint64))
            told.append(sketch(x))
            more.append(sketch(x, wide_cells(len(x))) if len(x) > LONG else None)
        columns = [pa.array(size, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)), pa.array(told, pa.binary()), pa.array(more, pa.binary())]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_code"], b["code"], *columns], names=["doc_id", "text_code", "code", "n", "h1", "h2", "sketch", "wide"])


class _Once:
    """Which rows have a code that was not there before. What is remembered is 8 bytes for each row of a task's input."""

    def __init__(self) -> None:
        self.seen = np.empty(0, np.int64)

    def new(self, codes: pa.Array) -> np.ndarray:
        codes = np.asarray(codes)
        fresh, at = np.unique(codes, return_index=True)
        known = np.isin(fresh, self.seen, assume_unique=True)
        self.seen = np.concatenate([self.seen, fresh[~known]])
        return np.sort(at[~known])


FREQUENT = 64


SIG_BYTES, CODE_BYTES = 5, 6  # of a signature beside its part, and of a code


def low_bytes(x: np.ndarray, size: int) -> bytes:
    """The `size` low bytes of each 64-bit number."""
    return x.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def from_low_bytes(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view(np.int64)[:, 0]


def part_of(sig: np.ndarray, parts: int) -> np.ndarray:
    return (((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _packed(sig: np.ndarray, codes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Signatures with their codes, as one row for each part they go to. Of a signature that a batch has FREQUENT
    times only those of the least and the greatest code go there: enough for the part to see that it is
    shared. The rest goes to a part beyond `parts` which takes all as shared, so no part grows with a frequent
    signature; whole signatures go there, since the part that they are of is not the row's."""
    part = part_of(sig, parts)
    by = np.lexsort((codes, sig))
    begin = np.flatnonzero(np.r_[True, sig[by][1:] != sig[by][:-1]]) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.r_[begin, len(sig)])
    many = np.repeat(size >= FREQUENT, size)
    many[begin] = many[begin + size - 1] = False
    part[by[many]] = parts + np.flatnonzero(many) % parts
    order = np.argsort(part, kind="stable")
    used, first = np.unique(part[order], return_index=True)
    ends = np.r_[first, len(sig)]
    told = [low_bytes(sig[order[a:z]], SIG_BYTES if p < parts else 8) for p, a, z in zip(used, ends[:-1], ends[1:])]
    theirs = [low_bytes(codes[order[a:z]], CODE_BYTES) for a, z in zip(ends[:-1], ends[1:])]
    return pa.RecordBatch.from_arrays([pa.array(used), pa.array(told, pa.binary()), pa.array(theirs, pa.binary())], names=["part", "sigs", "codes"])


def _low(code: str) -> Column:
    """What a part knows of a code. Nodes whose codes are equal in it are taken as candidates alike."""
    return F.col(code).bitwiseAND(F.lit((1 << 8 * CODE_BYTES) - 1))


def _signed(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, parts: int) -> Iterator[pa.RecordBatch]:
    """All signatures of a slice of texts, packed: part, sigs, codes. A text that a task meets again is not signed again."""
    once = _Once()
    for b in (x for batch in batches for x in slices(batch, most=PACKED_BYTES)):
        b = b.take(pa.array(once.new(b["text_code"])))
        if not b.num_rows:
            continue
        sigs = [signatures(x, num, den) if len(x) else x for part in slices(b) for x in shingles(part["text"], n)]
        yield _packed(np.concatenate(sigs), np.repeat(np.asarray(b["text_code"]), [len(s) for s in sigs]), parts)


def _shared(parts: int):
    def shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The signatures of a part that two texts or more have: region, code (CODE_BYTES of it)."""
        inner = key[0] < parts
        sig = from_low_bytes(b"".join(rows["sigs"]), SIG_BYTES if inner else 8)
        part = key[0] if inner else part_of(sig.view(np.uint64), parts)
        sig = part << 8 * SIG_BYTES | sig & (1 << 8 * SIG_BYTES) - 1  # the same for the frequent and the others
        code = from_low_bytes(b"".join(rows["codes"]), CODE_BYTES)
        if inner:
            order = np.lexsort((code, sig))
            sig, code = sig[order], code[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (code[1:] != code[:-1])]
            sig, code = sig[new], code[new]
            same = sig[1:] == sig[:-1]
            kept = np.r_[same, False] | np.r_[False, same]
            sig, code = sig[kept], code[kept]
        out = pd.DataFrame({"region": sig, "code": code})
        release()
        return out

    return shared


SKETCHES, PAIRS = 1 << 13, 1 << 12  # to a task: rows of sketches, of two sets
FILTERED = 1 << 14  # pairs; beyond these, sets are filtered by a bitmap before they are shuffled


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A written table of numbers, in no more tasks than it has use for."""
    out = written(spark, df, name)
    return fewer(spark, out, out.count())


def _wanted_sets(batches: Iterator[pa.RecordBatch], n: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for b in (x for batch in batches for x in slices(batch)):
        b = b.take(pa.array(np.flatnonzero(marked(bitmap, b["code"]))))
        b = b.take(pa.array(once.new(b["code"])))
        if b.num_rows:
            sets = list(shingles(b["text"], n))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_code"], b["code"], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "text_code", "code", "n", "shingles"])


def _fetched(spark: SparkSession, docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The written table (node, n, shingles) of wanted nodes (node, doc_id, text_code, code). A node is found by the
    code of its own row (doc_id and text), so its copies, which have other ids, are not moved."""
    bitmap = bitmap_of(wanted, "code")
    found = docs.select("doc_id", "text", "text_code", "code").mapInArrow(lambda it: trimmed(_wanted_sets(it, n, bitmap)), "doc_id long, text_code long, code long, n long, shingles binary")
    # joined by the code alone, so that sets are shuffled once: copies of a row meet where the join has put them
    of = wanted.groupBy("code").agg(F.collect_list(F.struct("node", "doc_id", "text_code")).alias("of"))
    rows = found.join(of, "code").select("*", F.explode("of").alias("w"))
    rows = rows.where(F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("text_code") == F.col("w.text_code")))
    return written(spark, rows.select("w.node", "code", "n", "shingles").dropDuplicates(["code", "node"]).select("node", "n", "shingles"), "shingles")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); the label is the smallest node reachable.

    Large-star and small-star steps in turn: each node's neighbours are joined to the smallest one.
    """
    edges = table(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    told = None
    while True:
        for large in (True, False):
            most = 2 * edges.count()
            both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
            both = fewer(spark, both, most)
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            near = both.join(least, "a")
            if large:
                near = near.where("b > a").select("b", "m")
            else:
                near = near.select("b", "m").union(least.select(F.col("a").alias("b"), "m"))
            edges = table(spark, fewer(spark, near, most).where("m <> b").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == told:
            break
        told = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _against(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The written table pairs (pivot, node) with the shingles of both."""
    rows = pairs.count()

    def of(column: str) -> DataFrame:
        """The sets of the nodes that stand in a column. Below FILTERED the planner may broadcast the pairs instead, and no set is shuffled."""
        own = sets.select("node", "shingles")
        if rows <= FILTERED:
            return own
        bitmap = bitmap_of(pairs.select(F.xxhash64(column).alias("code")).distinct(), "code")
        coded = own.withColumn("code", F.xxhash64("node"))
        return coded.mapInArrow(passing(bitmap, "code"), coded.schema).drop("code")

    mine = fewer(spark, pairs.join(of("node"), "node"), rows, PAIRS)
    # pivots are few: only their sets are shuffled
    its = of("pivot").select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles")).join(pairs.select("pivot").distinct(), "pivot", "left_semi")
    both = mine.join(its, "pivot")
    return fewer(spark, both.select("pivot", "node", "shingles", "pivot_shingles"), rows, PAIRS)


def sketch(x: np.ndarray, cells: int = CELLS) -> bytes:
    """How many shingles fall into each of a power of two of hash cells, up to 255; two cells to a byte where no count
    is over 15. The L1 distance of two sketches is never more than the number of shingles in which the sets differ."""
    n = np.minimum(np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)
    return (n if n.max() > 15 else n[::2] | n[1::2] << 4).tobytes()


def counted(sketches: list[bytes], cells: int = CELLS) -> np.ndarray:
    """The counts of sketches of so many cells, a row for each."""
    out, halved = np.empty((len(sketches), cells), np.uint8), np.array([len(s) < cells for s in sketches], bool)
    out[~halved] = np.frombuffer(b"".join(s for s in sketches if len(s) == cells), np.uint8).reshape(-1, cells)
    both = np.frombuffer(b"".join(s for s in sketches if len(s) < cells), np.uint8).reshape(-1, cells // 2)
    out[halved] = np.stack([both & 15, both >> 4], 2).reshape(-1, cells)
    return out


def wide_cells(n: int) -> int:
    """The cells of the wide sketch of n shingles."""
    return 1 << int(n).bit_length() - 1


def folded(wide: bytes, n: int, cells: int) -> np.ndarray:
    """The wide sketch of n shingles as one of `cells`."""
    return counted([wide], wide_cells(n)).reshape(-1, cells).sum(0, dtype=np.int32)[None]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The L1 distance of sketches."""
    kind = np.int16 if a.dtype == np.uint8 else np.int32
    return np.abs(a.astype(kind) - b.astype(kind)).sum(-1, dtype=np.int64)


def _may_link(a, n, b, m, num: int, den: int) -> np.ndarray:
    """Whether sketches are as near as those of linked sets of n and m shingles must be."""
    l1 = apart(a, b)
    return (l1 * (den + num) <= (n + m) * (den - num)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def most_apart(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many shingles a set of n and a set linked with it differ at most."""
    return (n + n * den // num) * (den - num) // (den + num)


def _near(spark: SparkSession, pairs: DataFrame, sketches: DataFrame, may_be_near) -> DataFrame:
    """The pairs (pivot, node) whose sketches and sizes pass may_be_near(x, n, y, m); those of long sets, in which
    CELLS cells tell little, are asked again with their wide sketches, of half as many cells as shingles or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (counted(b[c].to_pylist()) for c in ("x", "y"))
            ok = may_be_near(x, np.asarray(b["n"]), y, np.asarray(b["m"]))
            yield b.select(["pivot", "node", "n", "m"]).take(pa.array(np.flatnonzero(ok)))

    def keep_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, n, y, m in zip(b["x"].to_pylist(), np.asarray(b["n"]), b["y"].to_pylist(), np.asarray(b["m"])):
                cells = wide_cells(min(n, m))
                ok.append(bool(may_be_near(folded(x, n, cells), n, folded(y, m, cells), m)[0]))
            yield b.select(["pivot", "node"]).take(pa.array(np.flatnonzero(ok), pa.int64()))

    def both(pairs: DataFrame, column: str) -> DataFrame:
        rows = pairs.count()
        mine = sketches.select("node", F.col(column).alias("x"), "n")
        its = sketches.select(F.col("node").alias("pivot"), F.col(column).alias("y"), F.col("n").alias("m"))
        some = fewer(spark, pairs.select("pivot", "node").join(mine, "node"), rows, SKETCHES)
        return fewer(spark, some.join(its, "pivot").select("pivot", "node", "x", "n", "y", "m"), rows, SKETCHES)

    some = written(spark, both(pairs, "sketch").mapInArrow(lambda it: trimmed(keep(it)), "pivot long, node long, n long, m long"), "some")
    long = F.least("n", "m") > LONG
    some = fewer(spark, some, some.count())
    return some.where(~long).select("pivot", "node").union(both(some.where(long), "wide").mapInArrow(lambda it: trimmed(keep_long(it)), "pivot long, node long"))


def _each(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: the node's set, its pivot's, where each of the node's would be there, and whether it is."""
    last = p = None
    for pivot, mine, its in zip(b["pivot"].to_pylist(), b["shingles"], b["pivot_shingles"]):
        if pivot != last:
            last, p = pivot, np.frombuffer(its.as_py(), np.uint64)
        x = np.frombuffer(mine.as_py(), np.uint64)
        at = np.minimum(np.searchsorted(p, x), len(p) - 1)
        yield x, p, at, p[at] == x


def _distances(spark: SparkSession, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (pivot, node) with `linked`: whether den * intersection >= num * union."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, p, _, same in _each(b):
                m = int(np.count_nonzero(same))
                out.append(den * m >= num * (len(x) + len(p) - m))
            yield pa.RecordBatch.from_arrays([b["pivot"], b["node"], pa.array(out, pa.bool_())], names=["pivot", "node", "linked"])

    return _against(spark, pairs, sets).mapInArrow(lambda it: trimmed(count(it)), "pivot long, node long, linked boolean")


def _differences(spark: SparkSession, pairs: DataFrame, sets: DataFrame, num: int, den: int, far: bool) -> DataFrame:
    """The pairs (pivot, node) that are near (or all, with `far`): the number of shingles d in which they differ, these shingles (delta),
    and the most, k, that a link's two ends differ in."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, reach, delta = [], [], []
            for x, p, at, same in _each(b):
                d, k = len(x) + len(p) - 2 * int(np.count_nonzero(same)), most_apart(len(x), num, den)
                near = far or d <= most_apart(len(p), num, den) + k
                only = np.ones(len(p), bool)
                only[at[same]] = False
                size.append(d if near else -1), reach.append(k), delta.append(np.concatenate([x[~same], p[only]]) if near else x[:0])
            ends = np.cumsum([0] + [len(d) for d in delta]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(delta).view(np.int64)))
            out = pa.RecordBatch.from_arrays([b["pivot"], b["node"], pa.array(size, pa.int64()), pa.array(reach, pa.int64()), flat], names=["pivot", "node", "d", "k", "delta"])
            yield out.take(pa.array(np.flatnonzero(np.array(size) >= 0)))

    return _against(spark, pairs, sets).mapInArrow(lambda it: trimmed(differ(it)), "pivot long, node long, d long, k long, delta array<long>")


def _resigned(batches: Iterator[pa.RecordBatch], num: int, den: int, seed: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Signatures of another seed, packed: part, sigs, codes."""
    for b in batches:
        sigs = [signatures(np.frombuffer(x, np.uint64), num, den, seed) for x in b["shingles"].to_pylist()]
        if b.num_rows:
            yield _packed(np.concatenate(sigs), np.repeat(np.asarray(b["code"]), [len(s) for s in sigs]), parts)


def _cells(spark: SparkSession, cells: DataFrame, sets: DataFrame, sketches: DataFrame, num: int, den: int, seed: int) -> DataFrame:
    """The regions (region, node, label) that the cells of rows (pivot, node, label, inside, linked) fall into. Only
    pairs of different labels are still looked for. Far members are sieved with seed 1, and joined on their differences
    with later ones."""
    sieved = seed == 1

    def may_be_near(x, n, y, m):
        return apart(x, y) <= most_apart(n, num, den) + most_apart(m, num, den)

    close = cells.select("pivot", "node")
    if sieved:
        close = table(spark, _near(spark, close, sketches, may_be_near), "near")
    differ = written(spark, fewer(spark, _differences(spark, close, sets, num, den, not sieved), close.count()).join(cells, ["pivot", "node"]), "differences")
    tokens, rows = differ.agg(F.coalesce(F.sum(F.size("delta")), F.lit(0)), F.count(F.lit(1))).first()
    token = fewer(spark, differ.select("pivot", "node", "label", "k", "d", F.explode("delta").alias("token")), tokens)
    often = token.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("pivot", "token", "often")
    own = Window.partitionBy("pivot", "node")  # a document's own shingles
    # shingles that no other component has come first: each is one that a link's two ends differ in
    rank = F.row_number().over(own.orderBy("often", "token")) + F.col("d") - F.count(F.lit(1)).over(own)
    shared = token.join(often, ["pivot", "token"]).withColumn("rank", rank).where("rank <= k + 1").select(F.xxhash64("pivot", "token").alias("region"), "node", "label")
    # links of members whose differences share nothing: the two distances add up to k at most
    near = fewer(spark, differ.where("d <= k").select("pivot", "node", "label", "k", "inside", "d"), rows)
    window = near.groupBy("pivot").agg(F.max("k").alias("most"), F.min(F.when(~F.col("inside"), F.col("d"))).alias("least")).where("least is not null")
    near = near.join(window, "pivot").where("not inside or d + least <= most").select(F.xxhash64("pivot", F.lit("near")).alias("region"), "node", "label")
    if not sieved:
        return shared.union(near)
    # links of members that are both far from the pivot; who is linked with it is near
    apart_from = cells.where("not linked").groupBy("node").agg(F.min("label").alias("label"), F.collect_set(F.hash("pivot")).alias("pivots")).withColumn("code", F.xxhash64("node"))
    own = sets.select("n", "shingles", F.xxhash64("node").alias("code"))
    own = own.mapInArrow(passing(bitmap_of(apart_from.select("code"), "code"), "code"), own.schema)
    total = own.agg(F.sum("n")).first()[0] or 0
    parts = max(1, int(0.6 * total / PART_SIGNATURES))
    again = own.mapInArrow(lambda it: trimmed(_resigned(it, num, den, seed, parts)), "part long, sigs binary, codes binary")
    again = again.groupBy("part").applyInPandas(_shared(parts), "region long, code long").withColumnRenamed("region", "sig")
    again = again.coalesce(min(2 * parts, partitions(spark)))  # parts, and those of the frequent, are groups: more tasks have no rows
    again = again.join(apart_from.select(_low("code").alias("code"), "node", "label"), "code").select("sig", "node", "label")
    return shared.union(near).union(_parted(spark, table(spark, again, "signed-again"), apart_from.select("node", "pivots")))


def _parted(spark: SparkSession, again: DataFrame, cells: DataFrame) -> DataFrame:
    """The regions (region, node, label) of the written table again (sig, node, label) and cells (node, pivots): who has a signature and a
    pivot in common. Members have many pivots and signatures, but those that share both are mostly of one label: such regions go
    in the task that makes them, and none of a signature of one label is made. Of signatures that very many have, none is
    dropped here, so that no task holds one. Pivots that share a hash count as one, which makes their regions larger."""
    own, limit = Window.partitionBy("sig", "pivot"), _limit(spark, again.count())
    told = again.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    told = table(spark, told.select("sig", "k"), "signatures")
    large = F.broadcast(told.where(F.col("k") > limit).select("sig"))
    rest = again.join(large, "sig", "left_anti").join(told.where(F.col("k") <= limit).select("sig"), "sig")

    def each(rows: DataFrame) -> DataFrame:
        return rows.select("sig", "node", "label", F.explode("pivots").alias("pivot"))

    rest = each(rest.join(cells, "node").repartition("sig")).withColumn("x", F.min("label").over(own)).withColumn("y", F.max("label").over(own))
    some = each(again.join(large, "sig").join(cells, "node"))
    return rest.where("x < y").drop("x", "y").unionByName(some).select(F.xxhash64("pivot", "sig").alias("region"), "node", "label")


AT_ONCE = 4096


def _pairs(rows: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of rows of one region, ordered by region, that may be linked by their sketches."""
    region, n, sketches = rows["region"], rows["n"], rows["sketch"]
    at = np.arange(len(region))
    for lag in range(1, len(region)):
        at = at[: np.searchsorted(at, len(region) - lag)]
        at = at[region[at] == region[at + lag]]
        if not len(at):
            return
        small, large = np.minimum(n[at], n[at + lag]), np.maximum(n[at], n[at + lag])
        i = at[den * small >= num * large]
        if "label" in rows:
            i = i[rows["label"][i] != rows["label"][i + lag]]
        for k in range(0, len(i), AT_ONCE):
            x = i[k : k + AT_ONCE]
            x = x[_may_link(sketches[x], n[x], sketches[x + lag], n[x + lag], num, den)]
            yield x, x + lag


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole regions of LEAF_NODES rows at most, from rows sorted by region: what a batch may have begun waits for the next."""
    left = None
    for b in batches:
        rows = {c: np.asarray(b[c]) for c in b.schema.names if c != "sketch"}
        rows["sketch"] = counted(b["sketch"].to_pylist())
        if left is not None:
            rows = {c: np.concatenate([left[c], rows[c]]) for c in rows}
        if not len(rows["region"]):
            continue
        cut = int(np.searchsorted(rows["region"], rows["region"][-1]))
        left = {c: x[cut:] for c, x in rows.items()}
        if cut:
            yield {c: x[:cut] for c, x in rows.items()}
    if left is not None:
        yield left


def _leaf(num: int, den: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of small regions that are in different components and may be linked by their sketches."""
        for rows in _by_region(batches):
            for i, j in _pairs(rows, num, den):
                a, b = rows["node"][i], rows["node"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["pivot", "node"])

    return lambda batches: trimmed(join(batches))


def _paired(num: int, den: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of small regions that may be linked with another one of theirs."""
        for rows in _by_region(batches):
            ok = np.zeros(len(rows["region"]), bool)
            for i, j in _pairs(rows, num, den):
                ok[i] = ok[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][ok]) for c in ("region", "node")], names=["region", "node"])

    return lambda batches: trimmed(keep(batches))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("region").sortWithinPartitions("region")


def _roots(spark: SparkSession, docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The root regions (region, node, k): nodes that share a signature, equal regions once.

    Signatures go to their parts packed, about PART_SIGNATURES to a part; a part keeps those that texts share."""
    nodes = nodes.where("rid = node").select("node", "n", "text_code", "code")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, int(0.6 * total / PART_SIGNATURES))
    # of texts with equal sets one is signed, so a signature that only they have is not shared (where the bitmap is full: most of them)
    mine = passing(bitmap_of(nodes.select("code"), "code"), "code")
    signed = docs.select("text", "text_code", "code").mapInArrow(lambda it: trimmed(_signed(mine(it), n, num, den, parts)), "part long, sigs binary, codes binary")
    shared = signed.groupBy("part").applyInPandas(_shared(parts), "region long, code long")
    shared = shared.coalesce(min(2 * parts, partitions(spark)))
    return _merged(spark, shared.join(nodes.select(_low("text_code").alias("code"), "node").distinct(), "code").select("region", "node").distinct())


def _of_region(left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """left (region, k) joined with right, a row for each region. Regions of more than limit rows are joined by
    broadcast, the others by a shuffle; limit is such that there are few of the former."""
    large = F.col("k") > limit
    some = left.where(large).join(F.broadcast(right.where(large).drop("k")), "region")
    return some.unionByName(left.where(~large).join(right.where(~large).drop("k"), "region"))


def _limit(spark: SparkSession, rows: int) -> int:
    """Of a table of so many rows, fewer than four regions a partition have more than this."""
    return max(LEAF_NODES, rows // (4 * partitions(spark)))


def _merged(spark: SparkSession, members: DataFrame) -> DataFrame:
    """The written table (region, node, k) of regions of two nodes or more, one of those with the same nodes. If
    members have labels, regions with one label only go."""
    with scratch(spark, "regions"):
        return _of_two(spark, members)


def _of_two(spark: SparkSession, members: DataFrame) -> DataFrame:
    members = table(spark, members, "members")
    rows = members.count()
    counts = [F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    if "label" in members.columns:
        told = members.groupBy("region").agg(*counts, F.min("label").alias("from"), F.max("label").alias("to")).where("from < to")
    else:
        told = members.groupBy("region").agg(*counts)
    kept = told.where("k > 1").groupBy("k", "x", "y").agg(F.min("region").alias("region")).select("region", "k")
    kept, members = table(spark, kept, "kept"), members.select("region", "node")
    large = kept.where(F.col("k") > _limit(spark, rows))
    some = members.join(F.broadcast(large), "region")
    rest = members.join(F.broadcast(large.select("region")), "region", "left_anti").join(kept, "region")
    return table(spark, fewer(spark, some.unionByName(rest), rows), "regions")


def links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, sketches: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between nodes, enough to connect all that similarity connects. sketches: node, n, sketch, wide."""
    regions = _roots(spark, docs, nodes, n, num, den)
    # members of small regions stay where some other member's sketch doesn't rule a link out
    small = F.col("k") <= LEAF_NODES
    paired = _dealt(regions.where(small).select("region", "node").join(sketches.drop("wide"), "node")).mapInArrow(_paired(num, den), "region long, node long")
    regions = _merged(spark, paired.union(regions.where(~small).select("region", "node")))
    of = nodes.where("rid = node").select("node", "doc_id", "text_code", "code")
    wanted = table(spark, regions.select("node").distinct().join(of, "node"), "wanted")
    sketches = written(spark, wanted.select("node").join(sketches, "node"), "sketches", "zstd")
    shingled = _fetched(spark, docs, wanted, n)
    labels = spark.createDataFrame([], "node long, label long")
    pools = []

    def may_link(x, n, y, m):
        return _may_link(x, n, y, m, num, den)

    while True:
        limit = _limit(spark, regions.count())
        degree = regions.groupBy("node").agg(F.sum("k").alias("degree"))
        ranked = regions.join(degree, "node").groupBy("region", "k").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("pivot"))
        ranked = table(spark, ranked, "pivots")
        seen = table(spark, _of_region(regions, ranked, limit).where("node <> pivot").select("region", "node", "k", "pivot"), "cells")
        close = table(spark, _near(spark, table(spark, seen.select("pivot", "node").distinct(), "compared"), sketches, may_link), "close")
        linked = table(spark, _distances(spark, close, shingled, num, den), "distances")
        edges = linked.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(labels.select("label", "node"))
        labels = table(spark, components(spark, fewer(spark, edges, linked.count() + labels.count())), "labels")
        alive = seen.join(labels, "node", "left").groupBy("region", "k").agg(F.min(F.coalesce("label", "node")).alias("x"), F.max(F.coalesce("label", "node")).alias("y")).where("x < y").select("region", "k")
        seen = table(spark, _of_region(seen, table(spark, alive, "alive"), limit), "alive")
        pools.append(seen.where(small).select("region", "node"))
        cells = seen.where(~small).select("pivot", "node").distinct()
        if not cells.head(1):
            break
        named = labels.select(F.col("node").alias("pivot"), F.col("label").alias("of"))
        label, of = F.coalesce("label", "node"), F.coalesce("of", "pivot")
        cells = cells.join(labels, "node", "left").join(named, "pivot", "left").join(linked, ["pivot", "node"], "left")
        cells = table(spark, cells.select("pivot", "node", label.alias("label"), (label == of).alias("inside"), F.coalesce("linked", F.lit(False)).alias("linked")), "cells")
        with scratch(spark, "regions"):
            regions = _merged(spark, _cells(spark, cells, shingled, sketches, num, den, len(pools)))
    leaves = _merged(spark, reduce(DataFrame.union, pools)).join(labels, "node", "left").select("region", "node", F.coalesce("label", "node").alias("label")).join(sketches.drop("wide"), "node")
    pairs = written(spark, _dealt(leaves).mapInArrow(_leaf(num, den), "pivot long, node long").distinct(), "pairs")
    pairs = table(spark, _near(spark, fewer(spark, pairs, pairs.count()), sketches, may_link), "close")
    last = _distances(spark, pairs, shingled, num, den).where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(last)


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per document: doc_id, text_code, n_shingles, component_id, and keeper, true for one of each
    component. Two documents link when den * intersection >= num * union of their n-word shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("*", F.xxhash64("text").alias("text_code"))
    docs = docs.select("*", F.xxhash64("doc_id", "text_code").alias("code"))
    sets = docs.mapInArrow(lambda it: trimmed(_sets(it, n)), SETS).select(F.monotonically_increasing_id().alias("rid"), "*")
    sets = written(spark, sets, "sets", "zstd")
    key = ["n", "h1", "h2"]
    distinct = sets.where("n > 0").groupBy(*key).agg(F.min("rid").alias("node"), F.min("doc_id").alias("first"))
    nodes = written(spark, sets.where("n > 0").select("rid", "doc_id", "text_code", "code", *key).join(distinct, key), "nodes")
    with scratch(spark, "components"):
        edges = links(spark, docs, nodes, sets.select(F.col("rid").alias("node"), "n", "sketch", "wide"), n, num, den)
        labels = table(spark, components(spark, edges), "components")
    told = nodes.join(labels, "node", "left").select("rid", "first", F.coalesce("label", "node").alias("label"))
    told = told.join(sets.select("rid", "doc_id"), "rid")
    smallest = told.groupBy("label").agg(F.min("first").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("stays"))
    named = told.join(smallest, "label").select("rid", "component_id", (F.col("rid") == F.col("stays")).alias("keeper"))
    out = sets.select("rid", "doc_id", "text_code", "n").join(named, "rid", "left")
    return out.select("doc_id", "text_code", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("keeper", F.lit(True)).alias("keeper"))
