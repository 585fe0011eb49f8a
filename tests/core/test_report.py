"""Counts, copies, drawing in one pass, reports between editions, frozen tables and the document sink."""

import hashlib
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from spanmark.functions import codepoints as cp
from spanmark.functions.notation import UTHMANI, compile_rule, required
from spanmark.operators import annotations, corpus, editions, gates, render, report, spans
from spanmark.plans import catalogue
from spanmark.sources import document
from spanmark.sources.editions import write_json_spans, write_tsv

RULES = [("a.1", "th|dh"), ("b.1", "h ?e"), ("c.1", "[aeiou]")]
TEXTS = ["the dhow", "", None, "the dhow", "xyz", "o th e"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=repr)


def test_counts_are_those_of_spans(spark, docs):
    found = spans.analyzed(docs, RULES, ["doc_id"])
    assert rows(spans.counted(docs, RULES, ["doc_id"])) == rows(found.groupBy("doc_id", "rule_id").count())
    pairs = docs.withColumn("other", F.when(F.col("doc_id") == 4, "the").otherwise(F.col("text")))
    both = spans.counted(pairs, RULES, ["doc_id"], other="other")
    assert rows(both.where("n > 0").drop("n_other")) == rows(found.groupBy("doc_id", "rule_id").count())
    assert rows(both.where("doc_id = 4")) == [(4, "a.1", 0, 1), (4, "b.1", 0, 1), (4, "c.1", 0, 1)]
    assert spans.counted(docs.limit(0), RULES, ["doc_id"]).collect() == []


def test_counts_of_marked_texts_and_of_texts_as_they_are(spark):
    marked = corpus.marked(spark)
    d = catalogue._marked_docs(spark, "/root/testdata/sf0.001")
    rules = corpus.patterns(marked, corpus.selected(corpus.lineage(marked)), UTHMANI)
    found = spans.analyzed(d, rules, ["doc_id"], "codepoint_stream", corpus.originals(marked))
    counts = spans.counted(d, rules, ["doc_id"], "codepoint_stream", corpus.originals(marked))
    assert rows(counts) == rows(found.groupBy("doc_id", "rule_id").count()) and counts.count() > 100


def test_a_gate_only_leaves_out_what_cannot_match(spark):
    """182 rules over documents, and rules of marked text with vowels before the doubling mark, wildcards and anchors."""
    d = catalogue._docs(spark, "/root/testdata/sf0.001")
    rules = [(i, compile_rule(case, scope, dialect="python")) for i, case, scope in catalogue.MANY_RULES]
    needs = {i: required(case) for i, case, _ in catalogue.MANY_RULES}
    assert len(rules) == 182 and rows(spans.counted(d, rules, ["doc_id"], needs=needs)) == rows(spans.counted(d, rules, ["doc_id"]))
    marked = corpus.marked(spark)
    on, cases = corpus.originals(marked), {r["id"]: r["pattern_case"] for r in marked["rules"].collect()}
    m = catalogue._marked_docs(spark, "/root/testdata/sf0.001")
    rules = corpus.patterns(marked, corpus.selected(corpus.lineage(marked)), UTHMANI)
    plain = spans.counted(m, rules, ["doc_id"], "codepoint_stream", on)
    assert rows(plain) == rows(spans.counted(m, rules, ["doc_id"], "codepoint_stream", on, needs={i: required(cases[i], UTHMANI) for i, _ in rules}))
    assert required("[q_e ab] + [c]") == [frozenset({"q", "ab"}), frozenset({"c"})] and required("[_ a] + [word-end]") == []
    assert required(f"[{chr(0x646)}{cp.SHADDA}]", UTHMANI) == [frozenset({chr(0x646)})]


def test_sinks_and_lookups(spark, docs, tmp_path):
    found = spans.analyzed(docs, RULES, ["doc_id"], slices=True)
    write_json_spans(found, docs, str(tmp_path / "j"))
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("*.json")) for x in p.read_text().splitlines()]
    of = {x["doc_id"]: [(s["start_at"], s["end_at"], s["rule_id"]) for s in x["spans"]] for x in lines}
    assert set(of) == set(range(6)) and of[4] == [] and of[5] == [(0, 1, "c.1"), (2, 4, "a.1"), (3, 6, "b.1"), (5, 6, "c.1")]
    write_tsv(found, str(tmp_path / "t"))
    told = {tuple(x.split("\t")) for p in (tmp_path / "t").glob("*.txt") for x in p.read_text().splitlines()}
    assert ("5", "3", "6", "b.1", "h e") in told and len(told) == found.count()
    assert tuple(annotations.inline(spark, " the \n").first()) == ("-", "the")
    whole = {"version": "1", "riwayah": "r", "topics": [{"id": "t", "label": {"en": "T"}}], "categories": [{"id": "c", "topic": "t", "label": {"en": "C"}}], "hukums": [{"id": "h", "category": "c", "label": {"en": "H"}, "school": {"id": "north"}}], "rules": [{"id": "h.1", "hukum": "h", "case": "[th]", "scope": "within-word", "status": "stable", "label": {"en": "R"}}]}
    (tmp_path / "c.json").write_text(json.dumps(whole))
    read = corpus.load(spark, str(tmp_path / "c.json"))
    assert tuple(read["meta"].first()) == ("1", "r") and rows(corpus.lineage(read)) == [("h.1", "h", "c", "t", "north", "stable")]
    ids = spark.createDataFrame([(x,) for x in ("h.1", "h", "c", "t", "none")], "id string")
    assert {r["id"]: r["label"] and r["label"]["en"] for r in corpus.labels_of(read, ids).collect()} == {"h.1": "R", "h": "H", "c": "C", "t": "T", "none": None}
    assert corpus.patterns(read, corpus.lineage(read)) == [("h.1", compile_rule("[th]", "within-word", dialect="python"))] and gates.violations(read).collect() == []


def test_copies_are_annotated_once(spark, docs):
    copies = spark.range(300).select(F.col("id").alias("copy")).crossJoin(docs)
    assert rows(spans.analyzed_once(copies, RULES, ["copy", "doc_id"])) == rows(spans.analyzed(copies, RULES, ["copy", "doc_id"]))


def test_kept_spans_are_the_layer(spark, docs):
    found = spans.analyzed(docs, RULES, ["doc_id"], kept=True, slices=True)
    assert rows(found.where("kept").drop("kept", "slice")) == rows(spans.analyzed(docs, RULES, ["doc_id"], layer=True))
    assert rows(found.drop("kept", "slice")) == rows(spans.analyzed(docs, RULES, ["doc_id"]))


def test_summary_names_rulings_as_they_are_first_seen(spark, docs):
    lines = spark.createDataFrame([("a.1", "joined"), ("b.1", "breath"), ("c.1", "open")], "rule_id string, ruling_id string")
    got = {r["doc_id"]: (r["spans"], r["rulings"], r["seen"]) for r in annotations.summary(spans.analyzed(docs, RULES, ["doc_id"], kept=True), lines).collect()}
    assert got == {0: (5, 3, ["joined", "open"]), 3: (5, 3, ["joined", "open"]), 5: (4, 3, ["open", "joined"])}


def test_drawn_in_one_pass_as_from_a_table_of_spans(spark):
    d = catalogue._docs(spark, "/root/testdata/sf0.001")
    lines, rules = catalogue._rules(spark)
    told, found = catalogue._told(lines), spans.analyzed(d, rules, ["doc_id"])
    assert rows(render.annotated(d, rules, told=told, colours=catalogue._HTML)) == rows(render.to_html(d, found, rules=told, colours=catalogue._HTML))
    assert rows(render.annotated(d, rules, told=told, colours=catalogue._TERMINAL, terminal=True)) == rows(render.to_ansi(d, found, rules=told, colours=catalogue._TERMINAL))
    plan = render.annotated(d, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_marked_texts_are_drawn_as_from_a_table(spark):
    marked = corpus.marked(spark)
    d = catalogue._marked_docs(spark, "/root/testdata/sf0.001").limit(40)
    rules = corpus.patterns(marked, corpus.selected(corpus.lineage(marked)), UTHMANI)
    on = corpus.originals(marked)
    found = spans.analyzed(d, rules, ["doc_id"], "codepoint_stream", on)
    assert rows(render.annotated(d, rules, text="codepoint_stream", original=on)) == rows(render.to_html(d, found, text="codepoint_stream"))


def test_describe_is_asked_once_for_many_spans(spark, docs):
    def describe(of):
        assert of.schema.names == ["rule_id", "start_at", "end_at", "slice"]
        return pc.if_else(pc.equal(of["rule_id"], "c.1"), pa.scalar(None, pa.string()), pc.binary_join_element_wise(of["slice"], pc.cast(of["start_at"], pa.string()), "<"))

    got = {r["doc_id"]: r["html"] for r in render.annotated(docs, RULES, told={"c.1": ("vowels", "a vowel")}, describe=describe).collect()}
    assert got[2] is None and got[4] == "xyz" and got[1] == ""
    assert re.findall('title="([^"]*)"', got[0]) == ["th&lt;0", "a vowel", "dh&lt;4", "a vowel"]


@pytest.mark.parametrize("more", [{}, {"terminal": True}, {"describe": lambda of: of["slice"]}])
def test_renderings_leave_in_parts(spark, monkeypatch, more):
    """A rendering is many times as long as its text, so those of a whole batch are never held together."""
    held = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, draw, schema: held.append(draw) or self)
    texts = [None, "", *("this dhow said the oath " * 2000 for _ in range(40)), "th " * 200_000, None]
    render.annotated(spark.createDataFrame([], "doc_id long, text string"), RULES, **more)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text of the passage"])
    out = list(held[0](iter([batch, batch.slice(0, 0)])))
    assert [x for b in out for x in b["doc_id"].to_pylist()] == list(range(len(texts)))
    assert [x is None for b in out for x in b[1].to_pylist()] == [t is None for t in texts]
    assert max(sum(len(texts[k] or "") for k in b["doc_id"].to_pylist()[:-1]) for b in out) < 1 << 17


def test_what_lies_between_two_editions(spark):
    b, shadda, fatha = chr(0x628), cp.SHADDA, cp.FATHA
    left = spark.createDataFrame([(1, b + shadda + fatha), (2, "x" + chr(0x657)), (3, "th q"), (4, "same th"), (5, "gone"), (6, None)], "ref int, text string")
    right = spark.createDataFrame([(1, b + fatha + shadda), (2, "x" + chr(0x8F0)), (3, "tq"), (4, "same th"), (6, "new")], "ref int, text string")
    lines = spark.createDataFrame([("a.1", "r")], "rule_id string, ruling_id string")
    pairs = report.paired(left, right, "ref")
    got = report.between(pairs, "ref", [("tanween", chr(0x657), chr(0x8F0))], lines, [("a.1", "th")])
    assert got.columns == [c.split()[0] for c in report.ROW.split(", ")]
    told = {(r["section"], r["name"]): (r["reference"], r["other"], r["note"]) for r in got.collect()}
    digest = lambda pieces: hashlib.sha256("\x01".join(f"{k}\x00{t}" for k, t in pieces).encode()).hexdigest()
    assert told == {
        ("passages", "shared"): (4, None, None), ("passages", "identical"): (1, None, None), ("passages", "alike_folded"): (2, None, None), ("passages", "alike_tanween"): (3, None, None),
        ("passages", "differing"): (1, None, None), ("passages", "normalised_alike"): (3, None, None), ("missing", "5"): (None, None, None), ("apart", "3"): (None, None, None),
        ("differing", "3"): (1, None, "U+0074 U+0068 U+0020 U+0071 | U+0074 U+0071"), ("totals", "rules"): (1, None, None), ("totals", "spans"): (2, 1, None), ("rules", "a.1"): (2, 1, None),
        ("edition", "reference"): (5, None, digest([(1, b + shadda + fatha), (2, "x" + chr(0x657)), (3, "th q"), (4, "same th"), (5, "gone")])),
        ("edition", "other"): (5, None, digest([(1, b + fatha + shadda), (2, "x" + chr(0x8F0)), (3, "tq"), (4, "same th"), (6, "new")])),
    }


def test_frozen_tables_and_what_no_longer_holds(spark, docs):
    lines = spark.createDataFrame([("a.1",), ("b.1",), ("c.1",), ("none.1",)], "rule_id string")
    d = docs.where("text is not null")
    old = report.frozen(d, "doc_id", lines, [*RULES, ("none.1", "zzz")], "1.0", "e")
    assert report.regression(old, old).collect() == []
    of = {(r["section"], r["name"]): (r["passages"], r["occurrences"], r["digest"]) for r in old.collect()}
    short = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert of["incidence", "a.1"] == (3, 5, short("0,3,5")) and of["incidence", "none.1"] == (0, 0, short("")) and of["normalization", "4"] == (None, None, short("xyz"))
    assert of["corpus", "1.0"] == (None, None, None) and of["edition", "e"][0] == 5
    now = report.frozen(d.withColumn("text", F.replace("text", F.lit("dhow"), F.lit("dhow th"))), "doc_id", lines, RULES, "1.1", "e")
    got = {(r["section"], r["name"]): r["fault"] for r in report.regression(old, now).collect()}
    assert got == {("corpus", "1.0"): "gone", ("corpus", "1.1"): "not frozen", ("edition", "e"): "digest", ("incidence", "a.1"): "occurrences", ("normalization", "0"): "digest", ("normalization", "3"): "digest"}


def test_edition_faults(spark):
    docs = spark.createDataFrame([(1, cp.BEH + cp.FATHA + cp.ALEF_MADDA + chr(0x65B))], "doc_id int, text string")
    expected = [(cp.FATHA, "fatha", False), (cp.QURANIC_SUKOON, "sukoon", False), (cp.SMALL_WAW, "waw", True)]
    drifted = spark.createDataFrame([("r.1", "ok"), ("r.2", "problem")], "rule_id string, severity string")
    declared = editions.declared_marks(expected)
    assert {cp.FATHA, cp.SHADDA, cp.MADDAH, cp.PAUSE_MARKS[0], cp.SMALL_WAW} <= set(declared)
    got = rows(editions.edition_faults(docs, "x", "hafs", 1, expected, declared, drifted))
    assert got == [("problem", "missing", "sukoon"), ("problem", "riwayah", "x"), ("problem", "rule", "r.2"), ("problem", "unknown mark", "U+065B"), ("warning", "composed", "U+0622")]
    got = rows(editions.edition_faults(docs, "hafs", "hafs", 2, [], declared + chr(0x65B), None, composed=""))
    assert got == [("problem", "baseline", "no rule was compared with anything"), ("warning", "count", "1")]


def test_document_sink_gives_the_same_bytes(spark, tmp_path):
    table = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("é\"\n"), "id")).alias("text"))
    for n, parts in (("a", 1), ("b", 7), ("c", 3)):
        document.write_document(table.repartition(parts), str(tmp_path / n), ["k"], {"version": "1", "note": "ü"})
    texts = [(tmp_path / n).read_bytes() for n in "abc"]
    assert texts[0] == texts[1] == texts[2] and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c"]
    whole = json.loads(texts[0])
    assert whole["version"] == "1" and [r["k"] for r in whole["rows"]] == list(range(2000))
    head, back = document.read_document(spark, str(tmp_path / "a"), "version string, note string", "k long, text string")
    assert tuple(head.first()) == ("1", "ü") and rows(back) == rows(table)
    document.write_document(table.limit(0), str(tmp_path / "a"), ["k"], {})
    assert json.loads((tmp_path / "a").read_text()) == {"rows": []}


def test_document_sink_keeps_what_is_there_when_it_fails(spark, tmp_path):
    path = str(tmp_path / "a")
    document.write_document(spark.range(3), path, ["id"])
    before = (tmp_path / "a").read_bytes()
    bad = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no row"))).alias("id"))
    with pytest.raises(Exception, match="no row"):
        document.write_document(bad, path, ["id"])
    with pytest.raises(Exception, match="FileExists|exists"):
        document.write_document(spark.range(4), path, ["id"], overwrite=False)
    assert (tmp_path / "a").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["a"]


def test_report_and_frozen_table_through_the_sink(spark, docs, tmp_path):
    lines = spark.createDataFrame([("a.1",)], "rule_id string")
    old = report.frozen(docs.where("text is not null"), "doc_id", lines, RULES[:1], "1.0", "e")
    document.write_document(old, str(tmp_path / "f"), ["section", "name"])
    _, back = document.read_document(spark, str(tmp_path / "f"), "none string", report.FROZEN)
    assert report.regression(back, old).collect() == [] and gates.unequal(back, old).collect() == []
