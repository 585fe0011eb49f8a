"""The Merkle manifest against a plain recursion over lists."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmark.llm import manifest as mf
from spanmark.llm.queries import op11_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text))


def tree(nodes):
    """The root, and for each node its siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            run = at[k] // 8 * 8
            p.append((nodes[run : at[k]], nodes[at[k] + 1 : run + 8]))
        nodes, at = [H(nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [a // 8 for a in at]
    return nodes[0], paths


def plainly(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subs = [], []
    for g in names:
        of = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub, paths = tree([leaf(r, r[1]) for r in of])
        subs.append((sub, of, paths))
    root, stems = tree([s[0] for s in subs])
    for (sub, of, paths), stem in zip(subs, stems, strict=True):
        for r, path in zip(of, paths, strict=True):
            path = path + stem
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed and r[1] is not None else r[1])
            for left, right in path:
                now = H([*left, now, *right])
            out.append((r[0], leaf(r, r[1]), sub, root, H(x for a, b in path for x in a + b), now, now == root))
    return out


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    langs = [None, "", "a", "b", "B", "ä", "one"]
    rows = [(int(i), "Ab é\n" * int(rng.integers(0, 4)) + str(i % 5), langs[int(rng.integers(0, 6))] if i % 3 else "a", f"s{i % 4}", int(i % 7), "clash") for i in range(n)]
    rows += [(5, None, "a", None, None, None), (5, None, "a", None, None, None), (None, "X", "a", "s", 1, ""), (None, None, None, None, None, None), (7, "T", "one", "s", 1, "")]
    return rows


ORDER = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
key = lambda r: tuple(map(repr, r))


@pytest.mark.parametrize(("n", "levels"), [(700, 1), (60, 3), (300, 2)])
def test_equals_a_plain_recursion(spark, n, levels):
    """Small blocks, so that layers stand on layers; nulls, repeated rows, a clash of names, a language of one row."""
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r[c] for c in ORDER) for r in mf.document_manifest(spark, docs, levels).proved().collect()]
    assert sorted(got, key=key) == sorted(plainly(rows), key=key)


def test_empty_and_one_row(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mf.document_manifest(spark, docs).proved().collect() == []
    one = [(3, "A", None, "s", 1, "x")]
    got = mf.document_manifest(spark, spark.createDataFrame(one, SCHEMA)).proved().collect()
    assert [tuple(r[c] for c in ORDER) for r in got] == plainly(one)
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"]


def test_siblings_fold_to_the_parents():
    leaves = np.frombuffer("".join(H([str(k)]) for k in range(77)).encode(), np.uint8).reshape(-1, 64)
    levels = mf.levels_of(leaves, 77)
    assert [len(x) for x in levels] == [77, 10, 2, 1]
    assert (mf.folded(levels, leaves) == levels[-1]).all()
    assert [bytes(x) == bytes(levels[-1][0]) for x in mf.folded(levels, leaves[::-1])] == [k == 38 for k in range(77)]


def test_tampering_shows(spark):
    got = op11_manifest(spark, "/root/testdata/sf0.001").toPandas()
    changed = got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3 == 0)
    assert got["verified"][~changed].all() and not got["verified"][changed].all()
    assert (got["folded_root"] == got["root"]).equals(got["verified"])


def test_paths_prove_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = mf.document_manifest(spark, docs.withColumn("lang", F.col("source")))
    tops = {(r["tree"], r["block"]): r["top"] for r in made.blocks.collect()}
    for r in made.paths().collect():
        now = tops[r["tree"], r["block"]]
        for left, right in zip(r["left"], r["right"], strict=True):
            now = H([left, now, right])
        assert now == r["root"]
