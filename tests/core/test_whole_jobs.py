"""Queries take all documents, and give what brute force gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanmark.operators import editions, spans
from spanmark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_byte_offsets_takes_all_documents_and_the_whole_text(spark):
    texts = {r["doc_id"]: r["text"] for r in catalogue._docs(spark, SF).collect()}
    want = set()
    for r in catalogue.span_extract(spark, SF).collect():
        want |= {(r["doc_id"], len(texts[r["doc_id"]][:k].encode()), k) for k in (r["start_at"], r["end_at"])}
    got = [tuple(r) for r in catalogue.byte_offsets(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(b for _, b, _ in got) > 1000 and any(b != k for _, b, k in got)


def test_byte_and_codepoint_offsets():
    text = "aé\U0001f642b"
    assert spans.byte_offsets(text).tolist() == [0, 1, 3, 7, 8]
    at, off = spans.codepoint_offsets(text, np.arange(-1, 11))
    assert [None if o else a for a, o in zip(at.tolist(), off)] == [None, 0, 1, None, 2, None, None, None, 3, 4, None, None]
    assert spans.byte_offsets("").tolist() == [0]


def test_description_by_edits_is_that_by_table():
    deal = random.Random(3)
    for _ in range(3000):
        left, right = ("".join(deal.choice("ab c") for _ in range(deal.randrange(14))) for _ in range(2))
        assert editions.describe(left, right) == editions.describe(left, right, few=-1), (left, right)
    long = "the cat and the dog " * 5000
    assert editions.describe(long, long.replace("the dog ", "thy dog ", 3)) == " ; ".join(["U+0065 -> U+0079"] * 3)


def test_describe_difference_takes_the_documents(spark):
    d = catalogue._docs(spark, SF)
    pairs = {r["doc_id"]: (r["text"], r["b"]) for r in d.join(catalogue._other(d).select("doc_id", F.col("text").alias("b")), "doc_id").collect()}
    want = {k for k, (a, b) in pairs.items() if a.replace("é", "e") != b.replace("é", "e")}
    got = {r["doc_id"]: r["difference"] for r in catalogue.describe_difference(spark, SF).collect()}
    assert set(got) == want and want
    assert all(got[k] == editions.describe(*pairs[k], few=-1) for k in sorted(want, key=lambda k: len(pairs[k][0]))[:10])
