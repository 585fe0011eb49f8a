"""Digests of any size against hashlib."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from spanmark.operators import digests, editions, spans


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole(rows, between="\x01"):
    return sha(between.join(f"{r}\x00{t}" for r, t in sorted(x for x in rows if None not in x)))


def test_digests_hold_no_whole_edition(spark):
    rows = [("ab"[k % 3 == 0], 3000 - k, f"é{k}") for k in range(3000)] + [(None, 7, "x"), ("c", 1, None), ("a", 5000, None)]
    df = spark.createDataFrame(rows, "e string, ref int, text string").repartition(8)
    of = defaultdict(list)
    for e, r, t in rows:
        of[e].append((r, t))
    flat = editions.digest(df, "e", "ref", "text")
    assert {r["e"]: (r["passages"], r["digest"]) for r in flat.collect()} == {e: (len(x), whole(x)) for e, x in of.items()}
    blocked = editions.block_digest(df, "e", "ref", "text")
    want = {}
    for e, x in of.items():
        blocks = defaultdict(list)
        for r, t in x:
            blocks[r // digests.BLOCK].append((r, t))
        want[e] = (len(x), sha("\x01".join(f"{b}\x00{whole(blocks[b])}" for b in sorted(blocks))))
    assert {r["e"]: (r["passages"], r["digest"]) for r in blocked.collect()} == want
    for q in (flat, blocked):
        assert "collect_list" not in q._jdf.queryExecution().toString()


def test_incidence_digests(spark):
    rows = [("r", k % 2500) for k in range(4000)] + [("s", 10), ("s", 9), ("s", 10)]
    df = spark.createDataFrame(rows, "rule_id string, doc_id long")
    ids = {n: sorted({k for r, k in rows if r == n}) for n in "rs"}
    joined = lambda ks: ",".join(map(str, ks))
    got = spans.ordered_digest(df)
    assert "collect_set" not in got._jdf.queryExecution().toString()
    assert {r["rule_id"]: r["digest"] for r in got.collect()} == {n: sha(joined(k))[:16] for n, k in ids.items()}
    parts = {n: [(b, [k for k in ks if k // digests.BLOCK == b]) for b in range(3)] for n, ks in ids.items()}
    want = {n: sha("\x01".join(f"{b}\x00{sha(joined(k))}" for b, k in p if k))[:16] for n, p in parts.items()}
    assert {r["rule_id"]: r["digest"] for r in spans.block_digest(df).collect()} == want
