"""Normalisation vectors by code point, the notation, and spans against a scalar model."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spanmark.functions.normalize import hamzas, normalized, normalized_batch, source_range
from spanmark.functions.notation import LATIN, UTHMANI, bracket_fault, compile_rule, parse
from spanmark.operators import annotations, corpus, editions, gates, render, spans
from spanmark.sources.editions import as_of, from_positions, import_passages, read_edition
from spanmark.streaming import annotate

VECTORS = """
FEFF 0628 064E > 0628 064E
0628 06E1 > 0628 0652
0628 064E 0627 0653 > 0628 064E 0627
0628 064E 0622 > 0628 064E 0627
0628 0670 > 0628 0627
0628 0657 > 0628 064B
0628 064F 06E2 > 0628 064C
0628 064E 06E2 > 0628 064B
0628 0650 06E2 > 0628 064D
0628 064E 0640 0654 > 0628 064E 0621 0652
0640 064E 0654 > 0621 064E
0628 064E 06DC 062A 064E > 0628 064E 062A 064E
0623 064F 0648 0652 0644 > 0623 064F 0648 064E 0644 0652
0628 064E 062A > 0628 064E 062A 0652
0628 0651 064E > 0628 064E 0651
0628 064F 0648 > 0628 064F 0648
0628 0650 064A > 0628 0650 064A
0628 064E 0627 > 0628 064E 0627
0646 0651 064E > 0646 064E 0651
0628 064E 0645 > 0628 064E 0645 0652
"""
SAME = """
0645 08F0 = 0645 064B
0645 08F2 = 0645 0656
0645 064E 0651 06E2 0627 = 0645 0651 064E 06E2 0627
0628 0650 0640 0654 064E 0627 = 0628 064E 0650 0654 0627
0628 064E 0640 0654 06E1 = 0628 064E 0654 06E1
0644 06E1 0640 0654 064E 0670 0646 = 0644 064E 0670 06E1 0654 0646
0628 0651 0650 064A 0646 = 0628 0650 0651 064A 0646
0644 0651 064F 0648 0646 = 0644 064F 0651 0648 0646
0631 06EA 0649 0670 = 0631 065C 0649 0670
"""
# a maddah after a tatweel is a base of its own, and so is one between two hamzas: normalised texts before implied marks
HAMZAS = """
0640 0653 0654 > 0640 0653 0621
0628 0654 0653 0654 > 0628 0621 0653 0621
0628 064E 0654 0650 > 0628 064E 0621 0650
0628 0650 0654 0627 > 0628 0621 0650 0627
0644 0670 0652 0654 0646 > 0644 0652 0621 0670 0646
"""


def chars(hexes):
    return "".join(chr(int(h, 16)) for h in hexes.split())


def told(text):
    return " ".join(f"{ord(c):04X}" for c in text)


def test_hamza_vectors():
    for before, after in (line.split(" > ") for line in HAMZAS.strip().split("\n")):
        text, source = hamzas(chars(before))
        assert told(text) == after and len(source) == len(text), before


def test_normalisation_vectors(spark):
    pairs = [line.split(" > ") for line in VECTORS.strip().split("\n")]
    same = [line.split(" = ") for line in SAME.strip().split("\n")]
    texts = [chars(a) for a, _ in pairs] + [chars(x) for p in same for x in p] + ["plain", "", None, chars("0646 0652 06DC 0020 0628"), chars("0628 0651 064E 0640 0654 0645 06E1")]
    df = normalized(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    rows = {r["k"]: r for r in df.collect()}
    for k, (a, b) in enumerate(pairs):
        assert told(rows[k]["norm_text"]) == b, a
    for k, (a, b) in enumerate(same):
        i = len(pairs) + 2 * k
        assert rows[i]["norm_text"] == rows[i + 1]["norm_text"], (a, b, told(rows[i]["norm_text"]), told(rows[i + 1]["norm_text"]))
    for r in rows.values():
        if r["text"] is not None:
            assert r["norm_source"] == sorted(r["norm_source"]) and len(r["norm_source"]) == len(r["norm_text"])
    assert rows[len(pairs) - 1]["norm_source"][-1] == 3  # an implied mark stands at the end of the source
    assert "​" in rows[len(texts) - 2]["norm_text"] and rows[len(texts) - 5]["norm_text"] == "plain"
    ranges = df.where("k = 0").select(source_range(F.col("norm_source"), F.length("text"), F.lit(0), F.lit(2)).alias("r")).first()["r"]
    assert tuple(ranges) == (1, 3)


@pytest.mark.parametrize("profile,case,scope,subject,n", [
    (UTHMANI, "[ب ت]", "within-word", "0628 064E", 1), (UTHMANI, "[ب ت]", "within-word", "0646 064E", 0),
    (UTHMANI, "نّ", "within-word", "0646 0651 064E", 1),
    (UTHMANI, "[و وْ]", "within-word", "0647 064F 0648 064E", 0), (UTHMANI, "[و وْ]", "within-word", "0628 064E 0648 0652", 1),
    (UTHMANI, "و", "within-word", "0647 064F 0648 064E", 1),
    (UTHMANI, "نْ + [ب]", "within-word", "0646 0652 0020 0628 064E", 0), (UTHMANI, "نْ + [ب]", "within-word", "0646 0652 0628 064E", 1),
    (UTHMANI, "نْ + [ب]", "either", "0646 0652 0020 0628 064E", 1), (UTHMANI, "نْ + [ب]", "either", "0646 0652 0628 064E", 1),
    (UTHMANI, "نْ + [ب]", "within-word", "0646 0652 0640 0628 064E", 1),
    (LATIN, "[n] + word-end", "within-word", "006E 0020 006E 0061 006E", 2), (LATIN, "word-start + [n]", "either", "006E 0061 006E 0020 006E", 2),
    (LATIN, "[q_e]", "within-word", "0071 0078 0065 0071 000A 0065", 1),
])
def test_notation_in_both_dialects(spark, profile, case, scope, subject, n):
    text = chars(subject)
    df = spark.createDataFrame([(1, text)], "k int, text string")
    if profile is UTHMANI:
        df = normalized(df).select("k", F.col("norm_text").alias("text"))
    one = spans.find_spans(df, [("r", compile_rule(case, scope, profile, "python"))], ["k"]).collect()
    two = spans.find_spans_native(df, [("r", compile_rule(case, scope, profile, "java"))], ["k"]).collect()
    assert len(one) == n and [tuple(r) for r in one] == [tuple(r) for r in two]


def test_small_meem_under_a_kasra():
    for old, new in (("0628 0650 06ED", "0628 064D"), ("0628 0650 0651 06ED", "0628 064D 0651"), ("0628 064E 06ED", "0628 064E")):
        assert told(normalized_batch([chars(old)])[0][0]) == new


def test_brackets_stand_anywhere():
    assert parse("[a] [b] + [c", LATIN) == [["a", "b"], ["c"]]
    for name in UTHMANI.anchors:
        assert compile_rule(f"[ {name} ]", "either", UTHMANI) == compile_rule(name, "either", UTHMANI)


def test_lineage_is_strict(spark):
    demo = corpus.demo(spark)
    lost = demo | {"rulings": demo["rulings"].where("id <> 'th'")}
    with pytest.raises(Exception, match="th.1"):
        corpus.lineage(lost).collect()
    assert corpus.lineage(lost, "inner").count() == 11 and corpus.lineage(lost, "left").where("category_id is null").count() == 2


def test_digest_in_numeric_order(spark):
    rows = [("e", "10:1", "c"), ("e", "2:1", "a"), ("e", "2:10", "b")]
    got = editions.digest(spark.createDataFrame(rows, "id string, ref string, text string"), "id", "ref", "text").first()
    assert got["digest"] == hashlib.sha256(b"2:1\x00a\x012:10\x00b\x0110:1\x00c").hexdigest() and got["passages"] == 3


def test_fold_and_first_difference(spark):
    rows = [(1, "0622 0628 0651 064E", "0627 0653 0628 064E 0651"), (2, "0623 0650", "0627 0650 0654"), (3, "064E 0628", "064E 0628"), (4, "0628", "062A")]
    df = spark.createDataFrame([(k, chars(a), chars(b)) for k, a, b in rows], "k int, a string, b string")
    assert [r.k for r in df.where(editions.folded(F.col("a")) == editions.folded(F.col("b"))).orderBy("k").collect()] == [1, 2, 3]
    assert [tuple(r) for r in editions.first_differences(df, ["k"], "a", "b").where("k = 4").collect()] == [(4, 0, "U+0628", "U+062A")]
    assert df.where("k = 3").select(editions.code_point_dump(F.lit("a b"))).first()[0] == "a=0061 \u2423=0020 b=0062"


def test_annotation_sets(spark, tmp_path):
    corpus_rows = corpus.demo(spark) | {"meta": spark.createDataFrame([("1.0", "r")], "version string, riwayah string")}
    docs = spark.createDataFrame([("1:1", "the north"), ("1:2", "zzz"), ("10:1", "that"), ("2:1", "...")], "ref string, text string")
    lines = corpus.selected(corpus.lineage(corpus_rows))
    rules = corpus.patterns(corpus_rows, lines)
    found = spans.analyzed(docs, rules, ["ref"])
    ids = [i for i, _ in rules]
    annotations.write(spark, f"{tmp_path}/set", docs, found, ids, corpus_rows, "e", "r")
    back = annotations.read(spark, f"{tmp_path}/set", corpus_rows)
    assert sorted(map(tuple, back.select("ref", "rule_id", "start_at", "end_at").collect())) == sorted(map(tuple, found.collect()))
    annotations.verify(spark, f"{tmp_path}/set", docs)
    with pytest.raises(ValueError, match="digest"):
        annotations.verify(spark, f"{tmp_path}/set", docs.where("ref <> '1:2'"))
    with pytest.raises(ValueError, match="other"):
        annotations.write(spark, f"{tmp_path}/bad", docs, found, ids, corpus_rows, "e", "other")
    with pytest.raises(Exception, match="th.1"):
        annotations.read(spark, f"{tmp_path}/set", corpus_rows | {"rules": corpus_rows["rules"].where("id <> 'th.1'")}).collect()
    assert [tuple(r) for r in annotations.references(found, docs).collect()] == [("1:1", True), ("1:2", True), ("2:1", False), ("10:1", True)]
    assert [r.text for r in annotations.asked(docs, ["2:1", "1:1"]).collect()] == ["...", "the north"]
    with pytest.raises(Exception, match="9:9"):
        annotations.asked(docs, ["1:1", "9:9"]).collect()


def test_more_gates(spark):
    old = corpus.demo(spark)["rules"]
    row = lambda i, status, disputed, corrections=None: (i, "th", "[t]", "within-word", "normalized", status, None, None, False, {"en": i}, disputed, corrections)
    new = spark.createDataFrame([row("th.7", "stable", ("f", "x", ["1"], None)), row("th.8", "disputed", ("f", "x", ["1"], "y")), row("th.9", "stable", None, [("case", "a", "b")])], old.schema)
    topics = spark.createDataFrame([("letters",), ("letters",)], "id string")
    got = {tuple(r) for r in gates.violations(corpus.demo(spark) | {"rules": old.where("status <> 'disputed'").union(new), "topics": topics}).collect()}
    assert got == {("open-dispute-stable", "th.7"), ("settled-but-disputed", "th.8"), ("corrected-without-review", "th.9"), ("unique-topic", "letters"), ("category-without-topic", "open")}
    marked = spark.createDataFrame([("a.1", f"[{chars('0628')}] + {chars('06E5')}")], "id string, pattern_case string")
    assert marked.where(F.size(gates.stripped_marks(F.col("pattern_case"))) == 1).count() == 1
    told_of = gates.undescribed(corpus.demo(spark)["rules"], [("th", ["th."], "z")], "en", LATIN)
    assert {r.id for r in told_of.collect()} == {"th.1", "th.2"}
    lines = corpus.lineage(corpus.demo(spark))
    found = spark.createDataFrame([(1, "th.1", 0, 1), (1, "th.1", 2, 3), (2, "th.1", 0, 0)], "doc_id long, rule_id string, start_at long, end_at long")
    wanted = spark.createDataFrame([("th.1", 2, 3), ("th.2", 1, None), ("none.1", None, None), ("rare.1", 0, 0)], "rule_id string, passages long, occurrences long")
    assert {tuple(r) for r in gates.pinned(found, lines, wanted).collect()} == {("th.2", "passages"), ("none.1", "no such rule")}
    docs = spark.createDataFrame([(1, "ab"), (2, "abc")], "doc_id long, text string")
    assert {(r.doc_id, r.start_at, r.fault) for r in gates.ill_formed(found, docs).collect()} == {(1, 2, "past the end"), (2, 0, "empty")}
    frozen = gates.frozen(found, lines)
    assert gates.thawed(frozen, frozen).count() == 0 and frozen.count() == 13
    assert {tuple(r) for r in gates.thawed(frozen, gates.frozen(found.where("start_at = 0"), lines)).collect()} == {("th.1", "occurrences")}
    assert gates.unequal(docs, docs).count() == 0 and gates.unequal(docs, docs.where("doc_id = 1")).count() == 1
    assert corpus.chosen_topics(lines, []).count() == 0 and corpus.chosen_topics(lines, ["letters"]).count() > 5


def test_stream(spark, tmp_path):
    rows = [(1, "the", "2024-01-01 00:00:01"), (1, "the", "2024-01-01 00:00:02"), (2, "that th", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "doc_id long, text string, at string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").json(f"{tmp_path}/in")
    found = annotate.annotate_stream(stream, [("th", "th")], ["doc_id"], "at")
    told_at = annotate.incidence_stream(found, "at")
    told_at.writeStream.format("memory").queryName("told_at").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.occurrences for r in spark.table("told_at").collect()) == [1, 2]


def test_parse_and_brackets():
    assert parse("[a b] + c", LATIN) == [["a", "b"], ["c"]]
    assert [bracket_fault(c) for c in ("[a]", "[a [b]]", "a]", "[a")] == [None, "nested", "stray", "unclosed"]


def test_resolve(spark):
    rows = [(1, "a", 0, 5), (1, "b", 3, 8), (1, "c", 8, 10), (2, "short", 0, 2), (2, "long", 0, 6), (3, "a", 0, 2), (3, "b", 2, 4)]
    got = spans.resolve(spark.createDataFrame(rows, "k int, rule_id string, start_at long, end_at long"), ["k"]).collect()
    assert sorted(tuple(r)[:2] for r in got) == [(1, "a"), (1, "c"), (2, "long"), (3, "a"), (3, "b")]


def test_html_keeps_the_text(spark):
    docs = spark.createDataFrame([(1, 'a<b>&"the end"'), (2, ""), (3, "x")], "doc_id long, text string")
    found = spans.find_spans(docs, [("th", "th"), ("e", "e.")], ["doc_id"])
    for r in render.to_html(docs, found).join(docs, "doc_id").collect():
        plain = re.sub(r"<[^>]*>", "", r["html"])
        for a, b in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
            plain = plain.replace(a, b)
        assert plain == r["text"]
        assert ("<span" in r["html"]) == (r["doc_id"] == 1)


def test_gates_can_fail(spark):
    demo = corpus.demo(spark)
    assert gates.violations(demo).collect() == []
    bad = demo | {"rules": demo["rules"].union(spark.createDataFrame([("th.1", "gone", "[a", "either", "normalized", "stable", "x", None, False, {"en": "x"}, None, None)], corpus.RULE))}
    assert {r["gate"] for r in gates.violations(bad).collect()} == {"unique-rule", "rule-without-ruling", "namespace", "scope", "brackets", "gap-status"}
    flat = spark.createDataFrame([("r", 30), ("q", 10), ("s", 5), ("t", 20), ("u", 40), ("v", 19)], "rule_id string, passages long")
    gone = spark.createDataFrame([("q", 4), ("t", 9), ("u", 20), ("s", 500)], "rule_id string, passages long")
    assert {r["rule_id"]: r["severity"] for r in gates.drift(flat, gone).collect()} == {"r": "problem", "q": "ok", "s": "ok", "t": "warning", "u": "ok", "v": "ok"}
    more = [("th.8", "th", "[a", "within-word", "normalized", "disabled", "not-a-pattern", None, False, {}, None, None), ("th.9", "th", "a", "within-word", "normalized", "disputed", "lookahead", None, False, {}, ("f", "r", [], None), None)]
    assert gates.violations(demo | {"rules": demo["rules"].union(spark.createDataFrame(more, corpus.RULE))}).collect() == []


def test_errors_are_not_pruned_away(spark):
    demo = corpus.demo(spark)
    with pytest.raises(LookupError, match="none.9"):
        corpus.explained(demo, "none.9")
    with pytest.raises(LookupError, match="qqq"):
        corpus.search(demo["rules"], "qqq")
    lost = demo | {"rules": demo["rules"].union(spark.createDataFrame([("x.1", "gone", "[a]", "either", "normalized", "stable", None, None, False, {"en": "x"}, None, None)], corpus.RULE))}
    with pytest.raises(Exception, match="x.1"):
        corpus.lineage(lost).count()
    docs = spark.createDataFrame([("1:1", "a")], "ref string, text string")
    assert annotations.asked(docs, ["1:1"]).count() == 1
    with pytest.raises(Exception, match="no passage 9:9"):
        annotations.asked(docs, ["1:1", "9:9"]).count()
    found = spark.createDataFrame([(1, "a", 0, 1)], "doc_id long, rule_id string, start_at long, end_at long")
    with pytest.raises(Exception, match="no rule a"):
        spans.packed(found, ["b"], ["doc_id"]).collect()
    with pytest.raises(Exception, match="control characters"):
        spans.find_spans_native(spark.createDataFrame([(1, "a\x02th th")], "doc_id long, text string"), [("th", "th")], ["doc_id"]).collect()


def test_edition_digest_is_ordered_by_number(spark):
    import hashlib

    rows = spark.createDataFrame([("e", 10, "b"), ("e", 2, "a")], "e string, ref int, text string")
    assert editions.digest(rows, "e", "ref", "text").first()["digest"] == hashlib.sha256(b"2\x00a\x0110\x00b").hexdigest()


def test_byte_offsets(spark):
    df = spark.createDataFrame([("aé🙂b",)], "t string")
    got = [df.select(editions.byte_to_codepoint(F.col("t"), F.lit(k))).first()[0] for k in range(9)]
    assert got == [0, 1, None, 2, None, None, None, 3, 4]


def test_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": "e", "riwayah": "r", "script": "s", "source": {"a": 1}, "ayahs": {"2:1": "b", "10:1": "c"}}')
    assert sorted(tuple(r) for r in read_edition(spark, str(tmp_path / "e.json")).collect()) == [("e", "10:1", 10, 1, "c"), ("e", "2:1", 2, 1, "b")]
    for body in ('{"1:1": "x", "1:2": "y"}', '[{"surah": 1, "ayah": 1, "text": "x"}, {"surah": 1, "ayah": 2, "text": "y"}]', '[{"chapter": 1, "verse": 1, "arabic": "x"}, {"chapter": 1, "verse": 2, "arabic": "y"}]', '{"1": {"1": "x", "2": "y"}}'):
        (tmp_path / "i.json").write_text(body)
        assert sorted((r["ref"], r["text"]) for r in import_passages(spark, str(tmp_path / "i.json"), "e").collect()) == [("1:1", "x"), ("1:2", "y")], body
    for body in ('{"1:1": 5, "1:2": "b"}', '{"1:1": "x", "2": {"1": "y"}}', '{"1": {"1": 3}}', '[{"surah": 1, "text": "x"}]', '[{"surah": 1, "ayah": 1, "text": null}]', '{"a:1": "x"}', "{}", "[]", '"text"', "[4]"):
        (tmp_path / "i.json").write_text(body)
        with pytest.raises(Exception, match="could not read|no passages|neither"):
            import_passages(spark, str(tmp_path / "i.json"), "e").collect()
    (tmp_path / "i.json").write_text('[{"surah": "01", "ayah": 1, "text": "x"}, {"surah": 1, "ayah": 1, "text": "later"}]')
    assert [(r["ref"], r["text"]) for r in import_passages(spark, str(tmp_path / "i.json"), "e").collect()] == [("1:1", "later")]
    words = spark.createDataFrame(list(enumerate("a b c d e".split())), "pos long, word string")
    starts = spark.createDataFrame([(0, "1:1"), (2, "1:2")], "start long, ref string")
    marks = spark.createDataFrame([(1, 0, "after", "!"), (2, 0, "before", "~")], "pos long, k int, side string, sign string")
    assert sorted(tuple(r) for r in from_positions(words, starts, marks, 2).collect()) == [("1:1", "a b!"), ("1:2", "~ c d e")]
    two = spark.createDataFrame([(0, 0, "before", "1"), (0, 1, "after", "2"), (0, 2, "before", "3"), (0, 3, "after", "4")], marks.schema)
    assert from_positions(words, starts, two).where("ref = '1:1'").first()["text"] == "3 1 a24 b"
    with pytest.raises(ValueError, match="2 starts, but 3"):
        from_positions(words, starts, marks, 3)
    with pytest.raises(Exception, match="no sign"):
        from_positions(words, starts, spark.createDataFrame([(1, 0, "after", None)], marks.schema)).collect()


def test_as_of_equals_a_search_in_sorted_starts(spark):
    """Dense, sparse, negative and very far positions; blocks without starts; points before all starts; equal places."""
    import bisect
    import random

    rng = random.Random(7)
    place = lambda: rng.choice((rng.randint(-300_000, 300_000), rng.randint(-(1 << 62), 1 << 62), rng.randint(0, 50)))
    starts = [(place(), f"s{k:03d}") for k in range(250)]
    points = [(place(), k) for k in range(900)] + [(p, 1000 + k) for k, (p, _) in enumerate(starts[:100])] + [(-(1 << 63), 5000), ((1 << 63) - 1, 5001)]
    last = {}
    for p, v in starts:
        last[p] = max(v, last.get(p, ""))
    at = sorted(last)
    wanted = {k: last[at[i - 1]] if (i := bisect.bisect_right(at, p)) else None for p, k in points}
    got = as_of(spark.createDataFrame(points, "pos long, k long"), spark.createDataFrame(starts, "pos long, v string"), "v")
    assert {r["k"]: r["v"] for r in got.collect()} == wanted


def test_compare_folds_both_and_rewrites_the_left(spark):
    left = spark.createDataFrame([(1, "\u0628\u0651\u064e"), (2, "\u0622"), (3, "x\u0657"), (4, "x\u08f0"), (5, "q")], "ref int, text string")
    right = spark.createDataFrame([(1, "\u0628\u064e\u0651"), (2, "\u0627\u0653"), (3, "x\u08f0"), (4, "x\u0657"), (6, "q")], "ref int, text string")
    assert tuple(editions.compare(left, right, "ref", [("tanween", "\u0657", "\u08f0")]).first()) == (4, 0, 2, 3)


def test_marks_without_declared_ones(spark):
    docs = spark.createDataFrame([(1, "\u0628\u064e\u0628\u06e5")], "doc_id int, text string")
    assert [tuple(r) for r in editions.surviving_marks(docs, "").collect()] == [("\u064e", 1, 1)]


def test_rendering_joins_marks_and_pauses():
    noon, beh, alef, fatha, pause = "\u0646", "\u0628", "\u0627", "\u064e", "\u06da"
    told, colours = {"r": ("madd", "a \"b\"")}, render.COLOURS
    text = noon + fatha + beh + fatha
    opens = lambda r: render.tag(r, told, colours)
    got = render.html(text, [(0, 1, "r")], opens)
    assert f">{noon}{fatha}\u200d</span>\u200d{beh}" in got and 'title="a &quot;b&quot;"' in got and "color:#be123c" in got
    assert re.sub("<[^>]*>|\u200d", "", got) == text
    assert "\u200d" not in render.html(alef + beh, [(0, 1, "r")], opens)
    assert render.cuts(beh + pause + beh, [(0, 3, "r")]) == [(0, 1, "r"), (1, 2, None), (2, 3, "r")]
    assert render.cuts("abcd", [(0, 3, "r"), (1, 4, "q")]) == [(0, 3, "r"), (3, 4, None)]
    assert render.ansi("abc", [(1, 2, "r")], told, render.TERMINAL) == "a\x1b[38;5;161mb\x1b[0mc"
    assert render.html("", [], opens) == ""


def test_rendering_of_nulls_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "x")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "a", 0, 3), (1, "b", 2, 5), (1, "c", 3, 4), (2, "a", 0, 1)], "doc_id long, rule_id string, start_at long, end_at long")
    got = {r["doc_id"]: r["ansi"] for r in render.to_ansi(docs, found).collect()}
    assert got == {1: "abc\x1b[0md\x1b[0mef", 2: None, 3: "x"}
    assert [r["html"] for r in render.to_html(docs.where("doc_id > 1"), found).orderBy("doc_id").collect()] == [None, "x"]


def test_describe_difference(spark):
    assert editions.describe("abc", "abc") == ""
    assert editions.describe("abc", "axc") == "U+0062 -> U+0078"
    assert editions.describe("a b", "ab") == "U+0020 -> \u2014 (word separation only)"
    assert editions.describe("", "z") == "\u2014 -> U+007A"
    assert editions.describe(None, "z") is None
    for left, right in (("kitten", "sitting"), ("abcabba", "cbabac"), ("aab", "ab")):
        gone = sum(len(p.split(" -> ")[0].replace("\u2014", "").split()) for p in editions.describe(left, right).split(" ; "))
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, c in enumerate(left):
            for j, e in enumerate(right):
                table[i + 1][j + 1] = table[i][j] + 1 if c == e else max(table[i][j + 1], table[i + 1][j])
        assert len(left) - gone == table[-1][-1]
    rows = spark.createDataFrame([(1, "ab", "b")], "k int, a string, b string")
    assert editions.described(rows, "a", "b").first()["difference"] == "U+0061 -> \u2014"


def test_start_from(spark):
    rows = spark.createDataFrame([("r", "tth"), ("r", "xx"), ("s", "th")], "rule_id string, slice string")
    assert tuple(gates.start_from(rows, [("r", "t")]).first()) == ("r", 2, 1, 5, 3)
    assert tuple(gates.start_from(rows, [("r", "t")], total=True).first()) == (2, 1, 5, 3)
