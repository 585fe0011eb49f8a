"""The whole analysis: normalise, match, and tell the ranges of the original text."""

import random

from pyspark.sql import functions as F

from spanmark.functions import codepoints as cp
from spanmark.functions.normalize import AT_ONCE, in_parts, normalized, normalized_batch, normalized_by_passes, source_range
from spanmark.functions.notation import UTHMANI
from spanmark.operators import corpus, spans

# all that any pass looks at, the usual ones more often
USUAL = cp.BEH + cp.NOON + cp.LAM + cp.WAW + cp.YEH + cp.FATHA + cp.DAMMA + cp.KASRA + cp.SHADDA + cp.SUKOON + " "
CHARS = USUAL * 3 + cp.OPTIONAL_MARKS + cp.STACKED + cp.ALEF + cp.ALEF_HAMZA + cp.ALEF_MADDA + cp.HAMZA + cp.BOM + cp.QURANIC_SUKOON + cp.MADDAH + cp.SMALL_MEEM * 3 + cp.HAMZA_ABOVE * 3 + cp.TATWEEL * 3 + "ab\n\U0001f642"


def texts(n):
    deal = random.Random(5)
    silent = cp.ALEF_HAMZA + cp.DAMMA + cp.WAW + cp.SUKOON + cp.LAM
    made = ["".join(deal.choice(CHARS) for _ in range(deal.randrange(40))) for _ in range(n)]
    return [*made, silent, "", None, "plain", cp.BOM, cp.SHADDA + cp.WAW, cp.DAMMA + cp.SHADDA + cp.WAW]


def test_batch_normalisation_is_the_same(spark):
    rows = texts(3000)
    made = spark.createDataFrame(list(enumerate(rows)), "k int, text string").repartition(8)
    df = normalized_by_passes(made)
    one_pass = {r["k"]: (r["norm_text"], r["norm_source"]) for r in normalized(made).collect()}
    want = {r["k"]: (r["norm_text"], r["norm_source"]) for r in df.select("k", "norm_text", "norm_source").collect()}
    got = normalized_batch(rows)
    assert len(got) == len(rows)
    for k, t in enumerate(rows):
        if t is not None:
            assert (got[k][0], got[k][1].tolist()) == tuple(want[k]) == one_pass[k], ascii(t)
        else:
            assert one_pass[k] == (None, [])


def test_analysis_on_marked_text(spark):
    demo = corpus.marked(spark)
    rules, original = corpus.patterns(demo, corpus.lineage(demo), UTHMANI), corpus.originals(demo)
    assert original == {"twofold.2"}
    known = spark.createDataFrame([
        (1, cp.NOON + cp.BEH + cp.FATHA),  # bare before a marked letter: disjoined no more
        (2, cp.NOON + cp.QURANIC_SUKOON + cp.TATWEEL + cp.BEH),  # a folded spelling, a stripped mark
        (3, cp.BEH + cp.SHADDA + cp.FATHA),  # stacked marks, and the same as they are
        (4, None), (5, ""),
    ], "doc_id long, text string")
    got = sorted(tuple(r) for r in spans.analyzed(known, rules, ["doc_id"], original=original).collect())
    assert got == [(1, "sakin.1", 0, 2), (2, "sakin.1", 0, 4), (3, "twofold.1", 0, 3), (3, "twofold.2", 1, 3)]
    assert spans.find_spans(known.where("doc_id = 2"), rules, ["doc_id"]).count() == 0

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(2000))], "doc_id long, text string").repartition(8).cache()
    norm = normalized(docs).cache()
    at = source_range(F.col("norm_source"), F.length("text"), F.col("start_at"), F.col("end_at"))
    mapped = spans.find_spans(norm, [r for r in rules if r[0] not in original], ["doc_id"], "norm_text").join(norm, "doc_id").select("doc_id", "rule_id", at.alias("r")).select("doc_id", "rule_id", "r.*")
    want = mapped.union(spans.find_spans(docs, [r for r in rules if r[0] in original], ["doc_id"]))
    got = [tuple(r) for r in spans.analyzed(docs, rules, ["doc_id"], original=original).collect()]
    assert len(got) > 500 and sorted(got) == sorted(tuple(r) for r in want.collect())
    assert {g[1] for g in got} == {r for r, _ in rules}


def test_batches_are_cut_between_texts():
    half = "x" * (AT_ONCE // 2)
    assert list(in_parts([half, None, half, "y", half + half, "z"])) == [(0, 3), (3, 5), (5, 6)]
    assert list(in_parts([])) == []


def test_slices_and_layer_come_from_the_same_pass(spark):
    rules, original = corpus.patterns(demo := corpus.marked(spark), corpus.lineage(demo), UTHMANI), corpus.originals(demo)
    docs = spark.createDataFrame(list(enumerate(texts(1000))), "doc_id long, text string").repartition(8).cache()
    every = spans.analyzed(docs, rules, ["doc_id"], original=original)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.slice == text[r.doc_id][r.start_at : r.end_at] for r in spans.analyzed(docs, rules, ["doc_id"], original=original, slices=True).collect())
    layer = spans.analyzed(docs, rules, ["doc_id"], original=original, layer=True)
    assert sorted(map(tuple, layer.collect())) == sorted(map(tuple, spans.resolve(every, ["doc_id"]).collect()))
