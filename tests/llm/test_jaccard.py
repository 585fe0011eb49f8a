"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from spanmark.llm import jaccard
from spanmark.llm.jaccard import components, jaccard_components, signatures


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and den * m >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if v == old else v for v in label]
    least = {}
    for (doc_id, _), v in zip(rows, label):
        if doc_id is not None:
            least[v] = min(doc_id, least.get(v, doc_id))
    return sorted(((d, len(s), least.get(v)) for (d, _), s, v in zip(rows, sets, label)), key=str)


def made(seed, bases, copies, words):
    """Bases, copies with edits, copies of copies, tails and repeats."""
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 400)) for _ in range(rng.choice(words))]
        family = [base]
        for _ in range(copies):
            t = list(rng.choice(family))
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = f"new{rng.randint(0, 60)}"
            family.append(t + ["tail"] * rng.randint(0, 2))
        texts += [" ".join(t) for t in family]
    texts += [texts[0], texts[0].upper(), None, "", "  ", "one", "one", "two words", "Two\tWords", "a b c", "x " * 4000]
    rows = list(enumerate(texts)) + [(None, texts[1]), (None, "alone and null"), (3, texts[3]), (3, texts[3])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,num,den,leaf", [(3, 90, 100, 256), (5, 80, 100, 4), (3, 90, 100, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, n, num, den, leaf):
    monkeypatch.setattr(jaccard, "LEAF_NODES", leaf)
    rows = made(leaf, 6, 40, [8, 12, 30, 60, 200])
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, node int, region string")
    got = sorted((tuple(r) for r in jaccard_components(spark, docs, n, num, den).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, n, num, den)
    assert len({c for _, _, c in got}) < len(rows) - 60
    if leaf == 256:
        assert jaccard_components(spark, docs.limit(0)).collect() == []


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        for _ in range(400):
            size = int(rng.integers(5, 300))
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            out = int(rng.integers(0, len(x) // 5 + 1))
            y = np.unique(np.r_[x[rng.permutation(len(x))[out:]], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)])
            m = len(np.intersect1d(x, y))
            if den * m >= num * (len(x) + len(y) - m) and len(x) + len(y) != 2 * m:
                assert set(signatures(x, num, den).tolist()) & set(signatures(y, num, den).tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(tuple(r) for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_a_long_passage_in_common(spark, monkeypatch):
    """Documents that share most of a passage, some within the threshold, come to an end and lose no link."""
    import random

    monkeypatch.setattr(jaccard, "LEAF_NODES", 32)
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for i in range(48):
        own = [f"w{i if i % 3 else i // 9}x{j}" for j in range(draw.choice([2, 5, 9, 14, 40]))]
        texts.append(" ".join(passage + own if i % 2 else own + passage))
    sets = [{tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard.jaccard_components(spark, docs, 3, 90, 100).select("doc_id", "component_id").collect()
    assert dict(map(tuple, found)) == dict(enumerate(root)) and 1 < len(set(root)) < len(texts)


def test_signatures_are_packed_in_few_bytes():
    """Texts that share a signature are found from its part's rows, the frequent ones too, and rows hold 11 bytes a signature."""
    import pandas as pd

    rng = np.random.default_rng(3)
    parts = 7
    sigs = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    sigs[:200], sigs[200:400] = sigs[0], sigs[1000:1200]
    codes = rng.integers(-(2**63), 2**63, 4000)
    b = jaccard._packed(sigs, codes, parts).to_pandas()
    inner = b[b.part < parts]
    assert inner.sigs.map(len).sum() + inner.codes.map(len).sum() == 11 * inner.codes.map(len).sum() // 6
    found = pd.concat(jaccard._shared(parts)((p,), rows) for p, rows in b.groupby("part"))
    got = found.groupby("region").code.agg(frozenset)
    low = codes & ((1 << 48) - 1)
    want = {frozenset(low[:200].tolist())} | {frozenset((a, z)) for a, z in zip(low[200:400].tolist(), low[1000:1200].tolist())}
    assert set(got) == want


def test_sketches_are_exact():
    rng = np.random.default_rng(4)
    for n in (3, 200, 700, 5000, 40_000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for cells in (jaccard.CELLS, jaccard.wide_cells(max(len(x), 2))):
            want = np.minimum(np.bincount((x & np.uint64(cells - 1)).astype(int), minlength=cells), 255)
            raw = jaccard.sketch(x, cells)
            assert jaccard.counted([raw], cells)[0].tolist() == want.tolist()
            assert len(raw) == (cells if want.max() > 15 else cells // 2)


def test_sets_are_shuffled_once(spark):
    """Fetching the sets of nodes takes no second exchange of them, and copies of a row are one."""
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "f g h i j"), (None, "k l m n o")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.xxhash64("text").alias("text_code")).select("*", F.xxhash64("doc_id", "text_code").alias("code"))
    wanted = docs.select("doc_id", "text_code", "code").distinct().select(F.monotonically_increasing_id().alias("node"), "*")
    seen, own = [], jaccard.written
    jaccard.written = lambda s, df, name: seen.append(df) or own(s, df, name)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = jaccard._fetched(spark, docs, wanted, 3).collect()
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        jaccard.written = own
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["n"] for r in got) == [3, 3, 3] and len({r["node"] for r in got}) == 3
    assert sum("Exchange" in line and "shingles" in line for line in plan.split("\n")) == 0 and plan.count("Exchange hashpartitioning(code") <= 2


@pytest.mark.parametrize("limit", [2, 1000])
def test_far_members_are_parted_by_signature_and_pivot(spark, monkeypatch, limit):
    """Regions of one label are not made, but of signatures that more than `limit` have: those go on to be joined with all."""
    rng = random.Random(limit)
    monkeypatch.setattr(jaccard, "_limit", lambda *_: limit)
    cells = [(n, sorted(rng.sample(range(6), rng.randint(1, 4)))) for n in range(40)]
    label = {n: n // 5 * 5 for n in range(40)}
    again = [(s, n, label[n]) for s in range(30) for n in sorted(rng.sample(range(40), rng.randint(2, 6)) if s % 3 else range(s, s + 3))]
    of, want, dropped = dict(cells), set(), 0
    for s in range(30):
        nodes = [n for x, n, _ in again if x == s]
        if len({label[n] for n in nodes}) < 2:
            dropped += 1
            continue
        for p in range(6):
            inside = tuple(n for n in nodes if p in of[n])
            if inside and (len({label[n] for n in inside}) > 1 or len(nodes) > limit):
                want.add((s, p, inside))
    rows = spark.createDataFrame(again, "sig long, node long, label long")
    found = {}
    for r in jaccard._parted(spark, rows, spark.createDataFrame(cells, "node long, pivots array<int>")).collect():
        assert r.label == label[r.node]
        found.setdefault(r.region, []).append(r.node)
    assert sorted(tuple(sorted(x)) for x in found.values()) == sorted(x for *_, x in want) and dropped


def test_sets_of_pairs_are_filtered_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTERED", 3)
    sets = spark.createDataFrame([(n, 2, np.array([n, n + 1], np.uint64).tobytes()) for n in range(500)], "node long, n long, shingles binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (7, 8), (7, 1)], "pivot long, node long")
    got = {(r.pivot, r.node): (np.frombuffer(r.pivot_shingles, np.uint64)[0], np.frombuffer(r.shingles, np.uint64)[0]) for r in jaccard._against(spark, pairs, sets).collect()}
    assert got == {(p, n): (p, n) for p, n in [(1, 2), (1, 3), (7, 8), (7, 1)]}
    assert jaccard._against(spark, pairs, sets)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


def test_merged_regions_leave_one_table(spark, tmp_path, monkeypatch):
    """What they were made of would stay on disk until the last round."""
    import os

    from spanmark.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    rows = [(1, 5), (1, 6), (2, 5), (2, 6), (3, 7), (4, 6), (4, 7)]
    got = jaccard._merged(spark, spark.createDataFrame(rows, "region long, node long")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 5, 2), (1, 6, 2), (4, 6, 2), (4, 7, 2)]
    assert [x.rpartition("-")[0] for x in os.listdir(f"{tmp_path}/shared")] == ["regions"]
