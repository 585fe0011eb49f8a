"""Merkle manifest of a dataset: contiguous digest matrices, block by block.

Each row is a leaf: SHA-256 of its columns in a self-delimiting form. The leaves of a group (a language), in order, are the lowest
level of a tree in which every FANOUT consecutive nodes become their SHA-256; the groups' roots, in order, are the leaves of one more
tree, whose root pins the dataset.

A group's leaves are dealt out by range and numbered from counts of each range, so no task holds a group. FANOUT**LEVELS
consecutive nodes make a block: a numpy matrix of 64-byte hex digests, which is reshaped by FANOUT and hashed row by row, level after
level. A block's top is a node of the layer above, which is cut into blocks again until one node is left. On the way down each
block gets the siblings of its top, and index arithmetic gives every leaf's siblings inside the block.

Nulls: a null column counts as "-"; the null group is a tree of its own and comes first. Rows with a null order column come first in
their tree; rows of equal order go by their digest, and equal rows are leaves of their own. No rows: no result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bound_batches, trimmed, written

FANOUT, LEVELS = 8, 3  # nodes of a run; levels that a block has at most above its leaves
HEX = 64
INPUTS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "left array<string>, right array<string>, subroot string, root string"


def leaf_of(inputs: dict[str, Column]) -> Column:
    """The hex SHA-256 of the inputs one after another, each its UTF-8 byte count, a colon and itself, or "-" if null."""
    texts = [c.cast("string") for c in inputs.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _hashed(rows: list) -> np.ndarray:
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, HEX)


def _parents(nodes: np.ndarray) -> np.ndarray:
    """One digest for each FANOUT consecutive rows; the last run may be shorter."""
    full = len(nodes) // FANOUT * FANOUT
    rest = [nodes[full:].reshape(-1)] if full < len(nodes) else []
    return _hashed([*nodes[:full].reshape(-1, FANOUT * HEX), *rest])


def levels_of(leaves: np.ndarray, size: int, most: int = LEVELS) -> list[np.ndarray]:
    """A block's levels from its leaves (rows of hex digits) up. size: the nodes of the whole tree at the leaves' level, one of which ends it."""
    out = [leaves]
    for _ in range(most):
        if size == 1:
            break
        out.append(_parents(out[-1]))
        size = -(-size // FANOUT)
    return out


def _runs(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes at these indices of a level: where the run of each begins, its own place in it, and how many the run has."""
    begin = at // FANOUT * FANOUT
    return begin, at - begin, np.minimum(begin + FANOUT, len(nodes)) - begin


def siblings(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every leaf of a block and each level but the top: the other nodes of its run (FANOUT - 1 rows each), how many of them
    stand to its left and how many there are."""
    out, at = [], np.arange(len(levels[0]))
    for nodes in levels[:-1]:
        begin, own, many = _runs(nodes, at)
        others = begin[:, None] + np.arange(FANOUT - 1) + (np.arange(FANOUT - 1) >= own[:, None])
        out.append((nodes[np.minimum(others, len(nodes) - 1)], own, many - 1))
        at = at // FANOUT
    return out


def folded(levels: list[np.ndarray], leaves: np.ndarray) -> np.ndarray:
    """The block's top as it comes out if each leaf in turn were the given one and its siblings stayed."""
    at, now = np.arange(len(leaves)), leaves
    for nodes in levels[:-1]:
        begin, own, many = _runs(nodes, at)
        rows = nodes[np.minimum(begin[:, None] + np.arange(FANOUT), len(nodes) - 1)]
        rows[np.arange(len(rows)), own] = now
        now = _hashed([r[:m].reshape(-1) for r, m in zip(rows, many, strict=True)])
        at = at // FANOUT
    return now


def _matrix(digests) -> np.ndarray:
    """Rows of hex digits from an Arrow column of digests, or from the bytes of many."""
    whole = digests if isinstance(digests, bytes) else "".join(digests.to_pylist()).encode()
    return np.frombuffer(whole, np.uint8).reshape(-1, HEX)


def _numbered(spark: SparkSession, nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes (tree, order, ...) with place, from 0 in each tree, and size, the tree's nodes. Dealt out by range and written, so that
    the counts of ranges and the rows that are numbered by them are from the same deal."""
    keys = [F.col("tree"), *[F.col(c) for c in order]]
    dealt = written(spark, nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    counts = dealt.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return dealt.join(counts, ["tree", "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift", "salt")


def _blocks(spark: SparkSession, nodes: DataFrame, kept: str, levels: int, name: str) -> DataFrame:
    """A row a block: its nodes' digests one after another, its top, and what is kept of its nodes, in order."""

    def folds(table):
        import pyarrow as pa

        table = table.sort_by("place")
        size = table["size"][0].as_py()
        leaves = _matrix(table["digest"])
        row = {"tree": table["tree"][:1], "block": table["block"][:1], "size": table["size"][:1], "digests": pa.array([leaves.tobytes()]), "top": pa.array([levels_of(leaves, size, levels)[-1].tobytes().decode()])}
        if kept:
            row |= {"ids": pa.array([table["id"].to_pylist()], pa.list_(table.schema.field("id").type)), "given": pa.array([_matrix(table["given"]).tobytes()])}
        return pa.table(row)

    cut = nodes.withColumn("block", F.expr(f"place div {FANOUT**levels}"))
    return written(spark, cut.groupBy("tree", "block").applyInArrow(folds, f"tree string, block long, size long, digests binary, top string{kept}"), name)


def _climb(spark: SparkSession, nodes: DataFrame, kept: str, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The layers of blocks from nodes (tree, place, size, digest) up, and each tree's root (tree, top)."""
    layers, roots, block = [], [], FANOUT**levels
    while True:
        layers.append(_blocks(spark, nodes, kept if not layers else "", levels, f"{name}-{len(layers)}"))
        roots.append(layers[-1].where(F.col("size") <= block).select("tree", "top"))
        more = layers[-1].where(F.col("size") > block)
        if more.isEmpty():
            break
        nodes = more.select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / block).alias("size"), F.col("top").alias("digest"))
    return layers, reduce(DataFrame.unionByName, roots)


def _text(rows: np.ndarray) -> str:
    return rows.tobytes().decode()


def _spread(batches, most: int):
    """From blocks with the path above them: the path of each node of the block."""
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():
            levels = levels_of(_matrix(r["digests"]), r["size"], most)
            steps = siblings(levels)
            n = len(levels[0])
            rows = [{"tree": r["tree"], "block": r["block"] * FANOUT**most + k, "left": [_text(s[k, : o[k]]) for s, o, _ in steps] + r["left"], "right": [_text(s[k, o[k] : m[k]]) for s, o, m in steps] + r["right"], "subroot": r["subroot"], "root": r["root"]} for k in range(n)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]))


def _descend(layers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The lowest layer's blocks, each with its path (left and right siblings, level by level) from its top to the end of `above`."""
    path = None
    for k in range(len(layers) - 1, -1, -1):
        ends = layers[k].where(F.col("size") <= FANOUT**levels).select("tree", "block").join(above, "tree")
        path = ends if path is None else ends.unionByName(path)
        joined = layers[k].join(path, ["tree", "block"])
        if k == 0:
            return joined
        path = joined.mapInArrow(lambda batches: trimmed(_spread(batches, levels)), f"tree string, block long, {_PATH}")
    raise AssertionError


def _proved(batches, most: int):
    """From blocks with their paths: a row a leaf with its proof and the root that the given leaf leads to."""

    import pyarrow as pa

    for batch in batches:
        for at in range(batch.num_rows):
            r = {c: batch[c][at].as_py() for c in ("size", "digests", "given", "left", "right", "subroot", "root")}
            levels, given = levels_of(_matrix(r["digests"]), r["size"], most), _matrix(r["given"])
            steps, n = siblings(levels), len(given)
            above = "".join(a + b for a, b in zip(r["left"], r["right"], strict=True)).encode()
            tops: dict[bytes, str] = {}
            for top in set(map(bytes, ends := folded(levels, given))):
                now = top.decode()
                for a, b in zip(r["left"], r["right"], strict=True):
                    now = hashlib.sha256((a + now + b).encode()).hexdigest()
                tops[top] = now
            proofs = []
            for k in range(n):
                h = hashlib.sha256()
                for s, _, m in steps:
                    h.update(s[k, : m[k]].reshape(-1))
                h.update(above)
                proofs.append(h.hexdigest())
            ended = [tops[bytes(e)] for e in ends]
            yield pa.RecordBatch.from_arrays(
                [batch["ids"][at].values, pa.array([_text(x) for x in levels[0]]), pa.array([r["subroot"]] * n), pa.array([r["root"]] * n), pa.array(proofs), pa.array(ended), pa.array([e == r["root"] for e in ended])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


@dataclass
class Manifest:
    """The written tree of a dataset. blocks: the leaves, a row for each block of them, with the path above; roots: a row a group."""

    spark: SparkSession
    blocks: DataFrame
    roots: DataFrame
    id_type: str
    levels: int

    def paths(self) -> DataFrame:
        """tree, block, left and right siblings of each block's top up to the root, subroot and root: with `blocks`, all that a proof takes."""
        return self.blocks.select("tree", "block", "left", "right", "subroot", "root")

    def proved(self) -> DataFrame:
        """Per leaf: its digest, subroot, root, the SHA-256 of its siblings, the root that the given digest leads to, and whether that is the root."""
        bound_batches(self.spark)
        levels = self.levels
        return self.blocks.mapInArrow(lambda batches: trimmed(_proved(batches, levels)), f"doc_id {self.id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def build(spark: SparkSession, rows: DataFrame, group: str, order: str, digest: Column, given: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of rows: a tree for each value of `group`, leaves ascending by `order`, then digest. given: the digest that someone
    presents for the row, which proved() folds with the siblings written here; the row's own by default."""
    named = F.col(group).cast("string")
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("tree"), F.col(order).alias("id"), digest.alias("digest"), (digest if given is None else given).alias("given"))
    leaves = written(spark, leaves.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")
    kind = leaves.schema["id"].dataType.simpleString()
    layers, tops = _climb(spark, _numbered(spark, leaves, ["id", "digest", "salt"], "merkle-order"), f", ids array<{kind}>, given binary", levels, "merkle-blocks")
    trunk = tops.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("digest"), F.lit("").alias("given"))
    trunks, root = _climb(spark, _numbered(spark, trunk, ["id"], "merkle-trunk"), ", ids array<string>, given binary", levels, "merkle-trunk-blocks")
    none = F.array().cast("array<string>")
    ends = root.select("tree", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    stems = _descend(trunks, ends, levels)
    above = stems.mapInArrow(lambda batches: trimmed(_spread(batches, levels)), f"tree string, block long, {_PATH}")
    names = stems.select(F.posexplode("ids").alias("k", "name"), F.col("block").alias("b")).select((F.col("b") * FANOUT**levels + F.col("k")).alias("block"), F.col("name"))
    above = above.drop("tree", "subroot").join(names, "block").select(F.col("name").alias("tree"), "left", "right", "root").join(tops, "tree")
    roots = written(spark, above.select("tree", "left", "right", F.col("top").alias("subroot"), "root"), "merkle-roots")
    return Manifest(spark, _descend(layers, roots, levels), roots, kind, levels)


def document_manifest(spark: SparkSession, docs: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of documents by language, against texts of which a third lost their capitals."""
    own = {c: F.col(c) for c in INPUTS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    digest = leaf_of(own)
    return build(spark, docs, "lang", "doc_id", digest, F.when(changed, leaf_of(own | {"text": ascii_lower(F.col("text").cast("string"))})).otherwise(digest), levels)
