"""Substring removal and the FM-index against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanmark.llm.common import BLOCK_BYTES, slices, word_codes
from spanmark.llm.fm_index import FMIndex
from spanmark.llm import substrings
from spanmark.llm.substrings import Windows, find_repeats


def test_index_counts_windows():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 5, 8):
        seqs = [rng.integers(1, 4, int(rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
        queries = [rng.integers(1, 5, int(rng.integers(1, 50))).astype(np.uint64) for _ in range(40)] + seqs
        have = Counter(tuple(s[i : i + depth].tolist()) for s in seqs for i in range(len(s) - depth + 1))
        for q, got in zip(queries, FMIndex(seqs, depth).window_counts(queries)):
            assert got.tolist() == [have[tuple(q[i : i + depth].tolist())] for i in range(max(0, len(q) - depth + 1))]


def test_codes_and_slices_do_not_depend_on_blocks():
    """Words are coded alike wherever blocks end, also one longer than a block; slices lose no row, empty and null included."""
    rng = random.Random(5)
    some = ["a", "bé", "ccc", "x" * (BLOCK_BYTES + 7)]
    words = [rng.choice(some[:3]) for _ in range(BLOCK_BYTES)] + some + [rng.choice(some[:3]) for _ in range(999)]
    codes, ends = word_codes(pa.array([" ".join(words), None, "", "ccc\ta"]))
    own = {w: int(word_codes(pa.array([w]))[0][0]) for w in some}
    assert codes.tolist() == [own[w] for w in [*words, "ccc", "a"]] and len(set(own.values())) == 4
    assert ends.tolist() == [0, len(words), len(words), len(words), len(words) + 2]
    batch = pa.RecordBatch.from_pydict({"text": ["y" * 40, None, "", "y" * 7, "y" * 99, "y"]})
    parts = list(slices(batch, most=10))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p["text"].to_pylist()) <= 10 for p in parts)


@pytest.mark.parametrize("most", [1, 71, 400])
def test_segments_come_in_bounded_batches(monkeypatch, most):
    """A text of equal words has a segment for each window; they leave in batches of bounded size, none lost, in order."""
    texts = pa.array(["x " * 3000, "a b c " * 300, "", "one two"])
    value = Windows(texts, 35)
    lists = [sorted({int(v) for v in value.value[value.text == k].view(np.int64)}) for k in range(4)]
    batch = pa.RecordBatch.from_pydict({"uid": pa.array([1, 2, 3, 4]), "text": texts, "wanted": pa.array(lists, pa.list_(pa.int64())), "frequent": pa.array([lists[0], [], [], []], pa.list_(pa.int64()))})
    whole = pa.Table.from_batches(substrings._segments(iter([batch]), 35, True)).to_pylist()
    monkeypatch.setattr(substrings, "BATCH_WORDS", most)
    parts = list(substrings._segments(iter([batch]), 35, True))
    assert pa.Table.from_batches(parts).to_pylist() == whole and len(whole) >= 2966
    assert all(p.num_rows == 1 or sum(map(len, p["codes"].to_pylist())) <= 8 * most for p in parts) and len(parts) > 100


def brute(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "é", "zz."]) + str(rng.randint(0, 60))
    passages = [[word() for _ in range(rng.choice([34, 35, 36, 50, 90]))] for _ in range(8)]
    rows = []
    for i in range(120):
        t = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(passages)
        rows.append((i, "  ".join(t) if i % 3 else "\n".join(t)))
    rows += [(500, None), (501, ""), (502, " \t "), (503, "x " * 300), (504, "x y " * 40), (None, rows[5][1]), (7, rows[7][1]), (7, rows[7][1]), (505, " ".join(["nb"] * 80)), (506, "q " * 34), (507, "long " + " ".join(str(k) for k in range(9000)))]
    return rows


@pytest.mark.parametrize("window,hot,shard", [(35, 20_000, 400_000), (35, 3, 500), (5, 20_000, 2000)])
def test_equals_brute_force(spark, window, hot, shard):
    rows = made(window + hot)
    docs = spark.createDataFrame([(d, t, 3, "r") for d, t in rows], "doc_id long, text string, uid int, runs string")
    found = find_repeats(spark, docs, window, hot, shard).digests()
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == brute(rows, window)
    assert sum(r[2] for r in got) > 1000


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_repeats(spark, docs).digests().collect() == []
