"""All registered queries of the span engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmark.functions import codepoints as cp
from spanmark.functions import table
from spanmark.functions.older import ACCENTS, OLDER_LATIN, older_pattern
from spanmark.functions.normalize import normalized
from spanmark.functions.notation import LATIN, UTHMANI, compile_rule, required
from spanmark.operators import corpus as co
from spanmark.operators import annotations, editions, gates, older, render, report, spans
from spanmark.sources.editions import from_positions

KEY = ["doc_id"]


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text"), "lang", "source")


def _rules(spark, dialect="python", **chosen):
    demo = co.demo(spark)
    lines = co.selected(co.lineage(demo), **chosen)
    return lines, co.patterns(demo, lines, LATIN, dialect)


def _spans(spark, sf_dir, **chosen):
    lines, rules = _rules(spark, **chosen)
    return lines, spans.analyzed(_docs(spark, sf_dir), rules, KEY, original=co.originals(co.demo(spark)))


def _counts(spark, sf_dir, **chosen):
    lines, rules = _rules(spark, **chosen)
    return lines, spans.counted(_docs(spark, sf_dir), rules, KEY, original=co.originals(co.demo(spark)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidence of every demo rule over documents."""
    lines, counts = _counts(spark, sf_dir)
    return spans.incidence_of(counts, lines)


def span_extract(spark, sf_dir):
    return _spans(spark, sf_dir)[1]


def span_native(spark, sf_dir):
    return spans.find_spans_native(_docs(spark, sf_dir), _rules(spark, "java")[1], KEY)


def span_slice(spark, sf_dir):
    return spans.analyzed(_docs(spark, sf_dir), _rules(spark)[1], KEY, original=co.originals(co.demo(spark)), slices=True)


def resolve_overlaps(spark, sf_dir):
    return spans.analyzed(_docs(spark, sf_dir), _rules(spark)[1], KEY, original=co.originals(co.demo(spark)), layer=True)


def _told(lines):
    """Topic and description of each rule; the corpus is small by its nature."""
    return {r["rule_id"]: (r["topic_id"], f"{r['ruling_id']} \u2014 {r['rule_id']}") for r in lines.select("rule_id", "topic_id", "ruling_id").collect()}


def html_render(spark, sf_dir):
    lines, rules = _rules(spark)
    return render.annotated(_docs(spark, sf_dir), rules, original=co.originals(co.demo(spark)), told=_told(lines), colours=_HTML)


def ansi_render(spark, sf_dir):
    lines, rules = _rules(spark)
    return render.annotated(_docs(spark, sf_dir), rules, original=co.originals(co.demo(spark)), told=_told(lines), colours=_TERMINAL, terminal=True)


def html_described(spark, sf_dir):
    """With a callback that tells of each span how long it is, but of none of one code point or two."""

    def describe(spans_of: pa.RecordBatch) -> pa.Array:
        size = pc.subtract(spans_of["end_at"], spans_of["start_at"])
        return pc.if_else(pc.greater(size, 2), pc.binary_join_element_wise(spans_of["slice"], pc.cast(size, pa.string()), ": "), pa.scalar(None, pa.string()))

    lines, rules = _rules(spark)
    return render.annotated(_docs(spark, sf_dir), rules, original=co.originals(co.demo(spark)), told=_told(lines), colours=_HTML, describe=describe)


_HTML, _TERMINAL = {"letters": "#7e22ce", "sounds": "#0369a1"}, {"letters": 98, "sounds": 32}


def span_once(spark, sf_dir):
    return spans.analyzed_once(_docs(spark, sf_dir), _rules(spark)[1], KEY, original=co.originals(co.demo(spark)))


def passage_summary(spark, sf_dir):
    lines, rules = _rules(spark)
    found = spans.analyzed(_docs(spark, sf_dir), rules, KEY, original=co.originals(co.demo(spark)), kept=True)
    return annotations.summary(found, lines).withColumn("seen", F.array_join("seen", ","))


# the heads of the demo rules that have more than one group
def _heads(dialect):
    return [(r[0], compile_rule(r[2].split("+")[0].strip(), r[3], LATIN, dialect)) for r in co.DEMO_RULES if "+" in r[2] and r[4] != "disabled"]


def start_from_study(spark, sf_dir):
    return gates.start_from(span_slice(spark, sf_dir), _heads("java"))


def start_from_total(spark, sf_dir):
    return gates.start_from(span_slice(spark, sf_dir), _heads("java"), total=True)


def describe_difference(spark, sf_dir):
    d = _docs(spark, sf_dir)
    left = editions.residue(d, _other(d), "doc_id", [("accents", "é", "e")])
    return editions.described(left, "text", "other").select("doc_id", "difference")


def pack_unpack(spark, sf_dir):
    ids = sorted(r[0] for r in co.DEMO_RULES)
    return spans.unpacked(spans.packed(_spans(spark, sf_dir)[1], ids, KEY), ids, KEY)


def matches_flag(spark, sf_dir):
    rules = _rules(spark, "java")[1]
    return co.matches(_docs(spark, sf_dir), rules, [r for r, _ in rules] + ["none.1"])


def only_filter(spark, sf_dir):
    lines, counts = _counts(spark, sf_dir, only=["joined", "vowel.1"])
    return spans.incidence_of(counts, lines)


def school_filter(spark, sf_dir):
    lines, counts = _counts(spark, sf_dir, school="north")
    return spans.incidence_of(counts, lines)


def incidence_digest(spark, sf_dir):
    lines, found = _spans(spark, sf_dir)
    return spans.ordered_digest(found, lines=lines)


def incidence_block_digest(spark, sf_dir):
    return spans.block_digest(_spans(spark, sf_dir)[1])


def summary_per_doc(spark, sf_dir):
    per = _counts(spark, sf_dir)[1].groupBy("doc_id", "rule_id").agg(F.sum("n").alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("spans"), F.count(F.lit(1)).alias("rules"))


def first_appearance(spark, sf_dir):
    at = F.struct("start_at", (-F.col("end_at")).alias("back"))
    return _spans(spark, sf_dir)[1].groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min(at)["start_at"].alias("first_at"))


def lineage_rollup(spark, sf_dir):
    lines, counts = _counts(spark, sf_dir)
    return counts.join(lines, "rule_id").rollup("topic_id", "category_id", "ruling_id", "rule_id").agg(F.sum("n").alias("n"))


# A corpus drawn from documents, a rule a document, with every kind of fault in some; these expressions make its columns in Spark and in the SQL twins.
_K = "(case when doc_id % 103 = 1 then doc_id - 1 else doc_id end)"
_DRAWN = {
    "ruling": f"case when doc_id % 89 = 3 then 'none' else 'r' || cast({_K} % 40 as string) end",
    "id": f"case when doc_id % 97 = 5 then 'Odd_' || cast(doc_id as string) when doc_id % 89 = 3 then 'none.' || cast(doc_id as string) else 'r' || cast({_K} % 40 as string) || '.' || cast({_K} as string) end",
    "pattern_case": "case when doc_id % 83 = 2 then '[' else '' end || '[' || left(translate(lower(text), '.,[]+', '     '), 12) || ']' || case when doc_id % 79 = 4 then '" + cp.SMALL_WAW + "' else '' end || case when doc_id % 5 = 0 then ' + [b]' else '' end",
    "scope": "case when doc_id % 5 = 0 then 'either' when doc_id % 71 = 6 then 'across-words' else 'within-word' end",
    "subject": "case when doc_id % 61 = 9 then 'original' else 'normalized' end",
    "status": "case when doc_id % 7 = 0 then 'disabled' when doc_id % 11 = 0 then 'disputed' else 'stable' end",
    "gap": "case when doc_id % 7 = 0 and doc_id % 49 <> 0 then case doc_id % 3 when 0 then 'lookahead' when 1 then 'not-a-pattern' else 'negation' end when doc_id % 67 = 8 then 'lookahead' end",
    "reason": "case when doc_id % 7 = 0 then 'because of ' || cast(doc_id % 4 as string) end",
    "needs_review": "doc_id % 11 = 0",
}
_DISPUTE, _SETTLED, _CORRECTED = "(doc_id % 11 = 0 and doc_id % 121 <> 0 or doc_id % 113 = 7)", "doc_id % 55 = 0", "doc_id % 59 = 1"
_DRAWN_RULINGS = {"id": "'r' || cast(j as string)", "category": "case when j % 13 = 12 then 'nowhere' else 'c' || cast(j % 9 as string) end", "school": "case when j % 3 = 0 then 'north' end"}
_DRAWN_CATEGORIES = {"id": "'c' || cast(i as string)", "topic": "'t' || cast(i % 3 as string)"}


def _drawn_corpus(spark, sf_dir):
    """Rules, rulings r0 to r42 (the last three without rules) and categories c0 to c7."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = d.selectExpr(
        *(f"{e} as {c}" for c, e in _DRAWN.items()), "map('en', source || ' ' || lang) as label",
        f"case when {_DISPUTE} then named_struct('finding', 'f', 'raised_by', 'x', 'occurrences', array('1'), 'resolved_by', case when {_SETTLED} then 'y' end) end as disputed",
        f"case when {_CORRECTED} then array(named_struct('field', 'case', 'was', 'w', 'reason', 'r')) end as corrections",
    )
    of = lambda n, name: d.selectExpr(f"doc_id % {n} as {name}").distinct()
    return {"rules": rules, "rulings": of(43, "j").selectExpr(*(f"{e} as {c}" for c, e in _DRAWN_RULINGS.items())), "categories": of(8, "i").selectExpr(*(f"{e} as {c}" for c, e in _DRAWN_CATEGORIES.items()))}


def status_counts(spark, sf_dir):
    return _drawn_corpus(spark, sf_dir)["rules"].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def gaps(spark, sf_dir):
    return co.gaps(_drawn_corpus(spark, sf_dir)["rules"])


def rule_search(spark, sf_dir):
    return co.search(_drawn_corpus(spark, sf_dir)["rules"], "R1").select("id", "ruling")


def constraints(spark, sf_dir):
    return gates.violations(_drawn_corpus(spark, sf_dir))


def lineage_strict(spark, sf_dir):
    r, n, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


def lineage_left(spark, sf_dir):
    n, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


def edition_digest(spark, sf_dir):
    return editions.digest(_docs(spark, sf_dir), "lang", "doc_id", "text")


def edition_block_digest(spark, sf_dir):
    return editions.block_digest(_docs(spark, sf_dir), "lang", "doc_id", "text")


def _other(docs):
    """The other edition: some letters written otherwise, some passages missing."""
    return docs.where("doc_id % 11 <> 3").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.translate("text", "é", "e")).when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("the "), F.lit("thy "))).otherwise(F.col("text")))


def _pairs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", "text").join(_other(d).select("doc_id", F.col("text").alias("other")), "doc_id", "full")


def _both_counts(spark, sf_dir):
    """Counts of documents and of the other edition, from one pass over both texts of a passage."""
    lines, rules = _rules(spark)
    both = spans.counted(_pairs(spark, sf_dir), rules, KEY, original=co.originals(co.demo(spark)), other="other")
    return lines, both.where("n > 0").select("doc_id", "rule_id", "n"), both.where("n_other > 0").select("doc_id", "rule_id", F.col("n_other").alias("n"))


def edition_compare(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return editions.compare(d, _other(d), "doc_id", [("accents", "é", "e"), ("vowels", "y", "e")])


_CLASSES = [("accents", "é", "e"), ("vowels", "y", "e")]


def edition_report(spark, sf_dir):
    lines, rules = _rules(spark)
    return report.between(_pairs(spark, sf_dir), "doc_id", _CLASSES, lines, rules, co.originals(co.demo(spark)))


def edition_frozen(spark, sf_dir):
    lines, rules = _rules(spark)
    return report.frozen(_docs(spark, sf_dir), "doc_id", lines, rules, "1", "documents", co.originals(co.demo(spark)))


def edition_regression(spark, sf_dir):
    """Documents as they were frozen, against the other edition and a later corpus."""
    lines, rules = _rules(spark)
    now = report.frozen(_other(_docs(spark, sf_dir)), "doc_id", lines.where("rule_id <> 'th.1'"), rules, "2", "documents", co.originals(co.demo(spark)))
    return report.regression(edition_frozen(spark, sf_dir), now)


def edition_check(spark, sf_dir):
    """The other edition against a corpus for another text: what it lacks, what it has too much, which rules have drifted from documents."""
    lines, ours, theirs = _both_counts(spark, sf_dir)
    per = lambda counts: spans.incidence_of(counts, lines)
    theirs = theirs.where("rule_id <> 'pause.1' and (rule_id <> 'wild.1' or doc_id % 3 = 0)")  # one is gone, one is rarer
    other = _other(_docs(spark, sf_dir)).withColumn("text", F.translate("text", "q", cp.FATHA))
    expected = [("e", "e", False), (cp.QURANIC_SUKOON, "a mark", False), (cp.SMALL_WAW, "an optional mark", True)]
    return editions.edition_faults(other, "other", "own", 1000, expected, editions.declared_marks(expected[:1], "").replace(cp.FATHA, ""), gates.drift(per(ours), per(theirs)), composed="ß")


def edition_only_left(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.join(_other(d).select("doc_id"), "doc_id", "left_anti").select("doc_id")


def first_difference(spark, sf_dir):
    d = _docs(spark, sf_dir)
    both = d.join(_other(d).select("doc_id", F.col("text").alias("other")), "doc_id").where("text <> other")
    return editions.first_differences(both, KEY, "text", "other")


def char_census(spark, sf_dir):
    return editions.char_census(_docs(spark, sf_dir), "aeéüñ.")


def unknown_chars(spark, sf_dir):
    return editions.unknown_chars(_docs(spark, sf_dir), "a-z0-9 .,\\n")


def byte_offsets(spark, sf_dir):
    return spans.byte_ends(_docs(spark, sf_dir), _rules(spark)[1], KEY, original=co.originals(co.demo(spark)))


def drift_check(spark, sf_dir):
    """Odd passages against even ones; both counts come from one pass over the texts."""
    lines, counts = _counts(spark, sf_dir)
    per = counts.groupBy("rule_id", "doc_id").agg(F.sum("n"))
    told = lines.select("rule_id").join(per.groupBy("rule_id").agg(*(F.count_if(F.col("doc_id") % 2 == k).alias(n) for k, n in enumerate(("even", "odd")))), "rule_id", "left").fillna(0)
    return gates.drift(told.select("rule_id", F.col("even").alias("passages")), told.select("rule_id", F.col("odd").alias("passages")))


def expectations(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    pinned = labels.select(F.lit("pair.2").alias("rule_id"), "doc_id", (F.col("quality") == 1).alias("wanted"))
    return gates.expectations(_spans(spark, sf_dir)[1], pinned)


def differential_span(spark, sf_dir):
    _, rules = _rules(spark)
    d = _docs(spark, sf_dir)
    keys = ["doc_id", "rule_id", "start_at", "end_at"]
    original = co.originals(co.demo(spark))
    both = d.select("doc_id", "text").join(_other(d).select("doc_id", F.col("text").alias("other")), "doc_id", "full")
    # passages that are the same are annotated once
    same = spans.analyzed(both.where("text = other"), rules, KEY, original=original).groupBy("rule_id").agg(F.count(F.lit(1)).alias("both"))
    apart = both.where("not text <=> other")
    told = gates.differential(spans.analyzed(apart.where("text is not null"), rules, KEY, original=original), spans.analyzed(apart.where("other is not null"), rules, KEY, "other", original), keys)
    zero = F.lit(0).cast("long")
    return told.unionByName(same.select("rule_id", "both", zero.alias("only_ours"), zero.alias("only_theirs"))).groupBy("rule_id").agg(*(F.sum(c).alias(c) for c in ("both", "only_ours", "only_theirs")))


def frozen_regression(spark, sf_dir):
    d = _docs(spark, sf_dir)
    short = lambda x: F.substring(F.sha2("text", 256), 1, 16).alias(x)
    return d.select("doc_id", short("frozen")).join(_other(d).select("doc_id", short("actual")), "doc_id", "left").where(~F.col("frozen").eqNullSafe(F.col("actual")))


def zero_width(spark, sf_dir):
    return _spans(spark, sf_dir)[1].where("end_at <= start_at").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def positional_import(spark, sf_dir):
    """Items cut into words that stand one after another, at positions of their own, and put together again; every
    seventh word has a mark after it, every fifth two marks, the first of them before it."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.split("text", " ").alias("words"))
    starts = items.select(F.col("item_id").alias("ref"), F.shiftleft(F.col("item_id").cast("long"), 32).alias("start"))  # room for any item
    words = items.select("item_id", F.posexplode("words").alias("p", "word")).select((F.shiftleft(F.col("item_id").cast("long"), 32) + F.col("p")).alias("pos"), "word", "p")
    mark = lambda where, k, side, sign: words.where(where).select("pos", F.lit(k).alias("k"), F.lit(side).alias("side"), F.lit(sign).alias("sign"))
    marks = mark("p % 7 = 3", 0, "after", "*").union(mark("p % 5 = 2", 1, "before", "~")).union(mark("p % 5 = 2", 2, "before", "+"))
    return from_positions(words.select("pos", "word"), starts, marks)


def stable_filter(spark, sf_dir):
    lines = co.stable(co.lineage(co.demo(spark)))
    return spans.incidence_of(spans.counted(_docs(spark, sf_dir), co.patterns(co.demo(spark), lines), KEY), lines)


def topic_toggle(spark, sf_dir):
    lines = co.chosen_topics(co.selected(co.lineage(co.demo(spark))), ["sounds"])
    return spans.incidence_of(spans.counted(_docs(spark, sf_dir), co.patterns(co.demo(spark), lines), KEY), lines)


def review_marks(spark, sf_dir):
    return co.review_mark(_drawn_corpus(spark, sf_dir)["rules"])


def rules_standing(spark, sf_dir):
    return co.standing(_drawn_corpus(spark, sf_dir)["rules"])


def rule_lineage(spark, sf_dir):
    return co.lineage(_drawn_corpus(spark, sf_dir), "left").fillna("", ["school"])


def explain_rule(spark, sf_dir):
    return co.explained(_drawn_corpus(spark, sf_dir), "r9.9")


def incidence_change(spark, sf_dir):
    lines, ours, theirs = _both_counts(spark, sf_dir)
    return editions.incidence_change(spans.incidence_of(ours, lines), spans.incidence_of(theirs, lines))


def pinned_counts(spark, sf_dir):
    lines, found = _spans(spark, sf_dir)
    wanted = spark.createDataFrame(_PINNED, "rule_id string, passages long, occurrences long")
    return gates.pinned(found, lines, wanted)


_PINNED = [("rare.1", 0, 0), ("th.1", 1, None), ("th.2", None, 7), ("none.1", None, None), ("wild.1", None, None)]


def rule_samples(spark, sf_dir):
    return gates.samples(_spans(spark, sf_dir)[1])


def frozen_rules(spark, sf_dir):
    lines, ours, theirs = _both_counts(spark, sf_dir)
    return gates.thawed(gates.frozen_of(ours, lines), gates.frozen_of(theirs, lines))


def ill_formed_spans(spark, sf_dir):
    """Spans of the texts against the same without spaces, so that some end past them."""
    return gates.ill_formed(_spans(spark, sf_dir)[1], _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" "), F.lit(""))))


def unequal_editions(spark, sf_dir):
    d = _docs(spark, sf_dir)
    short = lambda x: x.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("digest"))
    return gates.unequal(short(d), short(_other(d)))


def rule_agreement(spark, sf_dir):
    """Against an edition annotated by a system with numbers for rules, of which two are not translated."""
    _, ours = _spans(spark, sf_dir)
    ids = spark.createDataFrame([(r[0], k) for k, r in enumerate(co.DEMO_RULES)], "rule_id string, number long")
    theirs = spans.analyzed(_other(_docs(spark, sf_dir)), _rules(spark)[1], KEY, original=co.originals(co.demo(spark)))
    theirs = theirs.join(F.broadcast(ids), "rule_id").select(F.col("number").alias("their_id"), "doc_id")
    return gates.agreement(ours, theirs, ids.where("number > 1").select("rule_id", F.col("number").alias("their_id")))


def annotated_refs(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("ref", F.concat_ws(":", F.expr("doc_id div 100 + 1"), F.expr("doc_id % 100 + 1")))
    return annotations.references(spans.analyzed(d, _rules(spark)[1], ["ref"]), d)


def annotation_totals(spark, sf_dir):
    return annotations.totals(_spans(spark, sf_dir)[1], _docs(spark, sf_dir), "doc_id")


def ayah_lists(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.expr("doc_id div 100").alias("surah"), (F.col("doc_id") % 100).alias("ayah"))
    return annotations.ayahs(d).select("surah", F.array_join("ayahs", ",").alias("ayahs"))


def code_point_dump(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", editions.code_point_dump(F.col("text")).alias("dump"))


def table_function(spark, sf_dir):
    table.register(spark)
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").createOrReplaceTempView("items_of_benchmark")
    return spark.sql("select item_id, start_at, end_at from items_of_benchmark, lateral rule_spans(text, '[aeiou]+t')")


def expected_chars(spark, sf_dir):
    return editions.checked(_docs(spark, sf_dir), _EXPECTED)


_EXPECTED = [("e", "e", False), ("é", "e acute", True), ("ß", "sharp s", True), ("\u06e1", "a mark", False), ("\u06e5", "an optional mark", True)]


def unknown_marks(spark, sf_dir):
    return editions.surviving_marks(_marked_docs(spark, sf_dir), cp.FATHA + cp.DAMMA + cp.SUKOON, "codepoint_stream")


def fold_marks(spark, sf_dir):
    return _marked_docs(spark, sf_dir).select("doc_id", editions.folded(F.col("codepoint_stream")).alias("folded"))


_FROM, _TO = "aeioubtnkmlrw", "".join(map(chr, (0x64E, 0x650, 0x651, 0x652, 0x64F, 0x628, 0x62A, 0x646, 0x643, 0x645, 0x644, 0x631, 0x648)))


def _marked_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.translate("text", _FROM, _TO).alias("codepoint_stream"))


def span_marked(spark, sf_dir):
    corpus = co.marked(spark)
    lines = co.selected(co.lineage(corpus))
    found = spans.analyzed(_marked_docs(spark, sf_dir), co.patterns(corpus, lines, UTHMANI), KEY, "codepoint_stream", co.originals(corpus))
    return found.join(F.broadcast(lines.select("rule_id", "ruling_id", "category_id", "topic_id")), "rule_id").select("doc_id", "rule_id", "ruling_id", "category_id", "topic_id", "start_at", "end_at")


def norm_full(spark, sf_dir):
    d = _marked_docs(spark, sf_dir)
    return normalized(d, "codepoint_stream").select("doc_id", "norm_text", F.size("norm_source").alias("n"))


# as many rules as a full corpus has: a letter, then another across a mark or not
MANY_RULES = [(f"pair.{k}", f"[{a}{b} {b}{a}{a}]" if k % 3 else f"[{a}{b}] + [{b} {a}n]", "within-word" if k % 3 else "across-words") for k, (a, b) in enumerate([(a, b) for a in "aeinorstlzqjx" for b in "bcdfghkmpuvwyw"][:182])]


def many_rules(spark, sf_dir):
    """Incidence of 182 rules, of which most can be ruled out for most passages."""
    needs = {i: required(case) for i, case, _ in MANY_RULES}
    counts = spans.counted(_docs(spark, sf_dir), [(i, compile_rule(case, scope, LATIN, "python")) for i, case, scope in MANY_RULES], KEY, needs=needs)
    return spans.incidence_of(counts, spark.createDataFrame([(i, "pairs") for i, *_ in MANY_RULES], "rule_id string, topic_id string"))


# letters of documents become every letter and mark that a pass acts on
_ALL_FROM = _FROM + "ghysdcfpvzxjq"
_ALL_TO = _TO + cp.ALEF + cp.HAMZA_ABOVE + cp.MADDAH + cp.SUPERSCRIPT_ALEF + cp.TATWEEL + cp.SMALL_MEEM + cp.QURANIC_SUKOON + cp.SMALL_SEEN + cp.ALEF_HAMZA + cp.BOM + chr(0x657) + cp.SMALL_LOW_MEEM + cp.ALEF_MADDA


def norm_letters(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.translate("text", _ALL_FROM, _ALL_TO).alias("codepoint_stream"))
    return normalized(d, "codepoint_stream").select("doc_id", "norm_text", F.size("norm_source").alias("n"))


def norm_strip(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.translate("text", "aeio", "ۥۦـٓ").alias("codepoint_stream"))
    return d.select("doc_id", F.translate("codepoint_stream", cp.OPTIONAL_MARKS, "").alias("stripped"))


# rules of the older dialect: the demo rules with white space of their own, and one that is no pattern
OLDER_RULES = [(r[0], r[2].replace(" + ", "+"), r"\s" if r[3] != "within-word" else " ?") for r in co.DEMO_RULES if r[4] != "disabled"] + [("broken.1", "[a(b]", " ")]
_ACCENTED, _FOLDED = "".join(v[1:] for v in ACCENTS.values()), "".join(k * (len(v) - 1) for k, v in ACCENTS.items())
_NUMBERS = [(r[0], k) for k, r in enumerate(OLDER_RULES)] + [("gone.1", 99)]
_EXCLUDED, _UNLISTED = [1], [2]


def _older(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("folded", F.translate("text", _ACCENTED, _FOLDED))
    return older.collected(d, OLDER_RULES, KEY, OLDER_LATIN, subject="folded")


def older_spans(spark, sf_dir):
    return _older(spark, sf_dir).select("doc_id", "rule_id", "nth", "start_at", "end_at", F.col("fault").isNotNull().alias("faulty"))


def _compared(spark, sf_dir):
    """Our spans of the folded texts, theirs, and the numbers of rules that can be compared."""
    d = _docs(spark, sf_dir).withColumn("text", F.translate("text", _ACCENTED, _FOLDED))
    lines, rules = _rules(spark)
    number = lambda ns: spark.createDataFrame([(n,) for n in ns], "their_id long")
    ids = older.comparable(spark.createDataFrame(_NUMBERS, "rule_id string, their_id long"), number(_EXCLUDED), number(_UNLISTED), lines)
    return spans.analyzed(d, rules, KEY), _older(spark, sf_dir).where("fault is null"), ids


def older_agreement(spark, sf_dir):
    ours, theirs, ids = _compared(spark, sf_dir)
    numbered = theirs.join(F.broadcast(spark.createDataFrame(_NUMBERS, "rule_id string, their_id long")), "rule_id").select("their_id", "doc_id")
    return gates.agreement(ours, numbered, ids)


def older_differential(spark, sf_dir):
    ours, theirs, ids = _compared(spark, sf_dir)
    known = F.broadcast(ids.select("rule_id"))
    return older.driven(ours.join(known, "rule_id", "left_semi"), theirs.where("start_at is not null").join(known, "rule_id", "left_semi"))


_QUERIES = {
    "rule_incidence": flagship,
    **{f.__name__: f for f in (many_rules, norm_letters, edition_report, edition_frozen, edition_regression, edition_check, html_described, span_once, passage_summary, older_spans, older_agreement, older_differential, span_extract, span_native, span_slice, resolve_overlaps, html_render, ansi_render, start_from_study, start_from_total, describe_difference, pack_unpack, matches_flag, only_filter, school_filter, incidence_digest, summary_per_doc, first_appearance, lineage_rollup, status_counts, gaps, rule_search, constraints, lineage_strict, lineage_left, edition_digest, edition_compare, edition_only_left, first_difference, char_census, unknown_chars, byte_offsets, drift_check, expectations, differential_span, frozen_regression, zero_width, positional_import, span_marked, norm_full, norm_strip, edition_block_digest, incidence_block_digest, stable_filter, topic_toggle, review_marks, rules_standing, rule_lineage, explain_rule, incidence_change, pinned_counts, rule_samples, frozen_rules, ill_formed_spans, unequal_editions, rule_agreement, annotated_refs, annotation_totals, ayah_lists, code_point_dump, table_function, expected_chars, unknown_marks, fold_marks)},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _text(s: str | None) -> str:
    return "cast(null as varchar)" if s is None else "'" + s.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"(select * from (values {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({names}))"


def _refs(spans_of: str) -> str:
    return f"select rule_id, string_agg(cast(doc_id as varchar), ',' order by doc_id) ids from (select distinct rule_id, doc_id from {spans_of}) group by 1"


def _frozen(spans_of: str, line: str) -> str:
    return f"select rule_id, coalesce(ids, '') ids, coalesce(n, 0) n from {line} l left join ({_refs(spans_of)}) using (rule_id) left join (select rule_id, count(*) n from {spans_of} group by 1) using (rule_id)"


def _near(text: str) -> str:
    part = f"substring({text}, greatest(k - 10, 0) + 1, k + 10 - greatest(k - 10, 0))"
    return f"array_to_string(list_transform(list_filter(string_split({part}, ''), lambda c: c <> ''), lambda c: 'U+' || printf('%04X', unicode(c))), ' ')"


def _normalised(low: str) -> str:
    """n0, the code-point stream of documents, to n13, the same after all passes that its letters can meet."""
    marks, vowels = cp.DIACRITICS + cp.SUPERSCRIPT_ALEF, cp.VOWELS

    def among(c: str, chars: str) -> str:
        return f"coalesce({c} in ({', '.join(_text(x) for x in chars)}), false)"

    before = f"case when c[i - 1] = {_text(cp.SHADDA)} and i > 2 then c[i - 2] when i > 1 then c[i - 1] end"
    long = f"coalesce((c[i] = {_text(cp.WAW)} and ({before}) = {_text(cp.DAMMA)}) or (c[i] = {_text(cp.YEH)} and ({before}) = {_text(cp.KASRA)}), false)"
    apart = f"({among('c[i + 1]', cp.CONSONANTS)} and not {among('c[i + 2]', marks)})"
    bare = f"{among('c[i]', cp.CONSONANTS)} and not {among('c[i + 1]', marks + cp.MADDAH)} and not {long} and not {apart}"
    return f"""n0 as (select doc_id, translate(text, '{_FROM}', '{_TO}') t from {low}),
n9 as (select doc_id, replace(t, '{cp.ALEF_HAMZA}{cp.DAMMA}{cp.WAW}{cp.SUKOON}{cp.LAM}', '{cp.ALEF_HAMZA}{cp.DAMMA}{cp.WAW}{cp.FATHA}{cp.LAM}') t from n0),
l9 as (select doc_id, list_filter(string_split(t, ''), lambda x: x <> '') c from n9),
n10 as (select doc_id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: c[i] || case when {bare} then {_text(cp.SUKOON)} else '' end), '') t from l9),
n13 as (select doc_id, regexp_replace(t, '{cp.SHADDA}([{vowels}])', '\\1{cp.SHADDA}', 'g') t from n10)"""


def _older_cte() -> str:
    """older: the older engine's spans and the matches without any (nth 0), of documents in lower case."""
    low = "(select doc_id, lower(text) as text from documents)"
    hits = "\nunion all ".join(f"select doc_id, {_text(i)} rule_id, regexp_extract_all(folded, {_text(older_pattern(c, w, OLDER_LATIN))}) f from fd" for i, c, w in OLDER_RULES if i != "broken.1")
    arms = " ".join(f"when {_text(k)} then {_text('(?:' + '|'.join(v) + ')')}" for k, v in ACCENTS.items())
    wild = "array_to_string(list_transform(list_filter(string_split(f, ''), lambda c: c <> ''), lambda c: case c " + arms + " else regexp_replace(c, '([^\\p{L}\\p{N}\\s])', '\\\\\\1') end || '[*%]*'), '')"
    return f"""fd as (select doc_id, text, translate(text, '{_ACCENTED}', '{_FOLDED}') folded from {low}),
hs as ({hits}),
hu as (select doc_id, rule_id, unnest(f) f, unnest(range(1, len(f) + 1)) k from hs where len(f) > 0),
hd as (select doc_id, rule_id, f, min(k) k from hu group by 1, 2, 3),
hp as (select doc_id, rule_id, k, string_split(regexp_replace(text, '(' || {wild} || '[.,]*)', chr(1) || '\\1' || chr(2), 'g'), chr(1)) p from hd join fd using (doc_id)),
hx as (select doc_id, rule_id, k, unnest(p) x, unnest(range(1, len(p) + 1)) j from hp),
hy as (select *, coalesce(sum(length(replace(x, chr(2), ''))) over (partition by doc_id, rule_id, k order by j rows between unbounded preceding and 1 preceding), 0) b from hx),
hz as (select doc_id, rule_id, row_number() over (partition by doc_id, rule_id order by k, j) nth, cast(b as bigint) start_at, cast(b + instr(x, chr(2)) - 1 as bigint) end_at from hy where j > 1),
older as (select * from hz union all select distinct doc_id, rule_id, 0, cast(null as bigint), cast(null as bigint) from hd where (doc_id, rule_id) not in (select (doc_id, rule_id) from hz))"""


def _all_passes(low: str) -> str:
    """z, the normalised texts of norm_letters: the passes one after another as patterns, the implied marks by neighbours in a list."""
    marks = cp.DIACRITICS + cp.SUPERSCRIPT_ALEF
    other = cp.STACKED.replace(cp.HAMZA_ABOVE, "")
    new = chr(0xE000)  # a hamza that a pattern has put there, which is no base for the next
    base = f"([^{cp.DIACRITICS}{cp.SUPERSCRIPT_ALEF}{cp.TATWEEL}{cp.HAMZA_ABOVE}{new}])"

    def among(c: str, chars: str) -> str:
        return f"coalesce({c} in ({', '.join(_text(x) for x in chars)}), false)"

    def each(t: str, *pairs: tuple[str, str]) -> str:
        for old, new in pairs:
            t = f"regexp_replace({t}, {_text(old)}, {_text(new)}, 'g')"
        return t

    tanween = [(cp.FATHA, cp.SMALL_MEEM, cp.FATHATAN), (cp.DAMMA, cp.SMALL_MEEM, cp.DAMMATAN), (cp.KASRA, f"[{cp.SMALL_MEEM}{cp.SMALL_LOW_MEEM}]", cp.KASRATAN)]
    one = each("t", (cp.BOM, ""), (cp.QURANIC_SUKOON, cp.SUKOON), (cp.ALEF + cp.MADDAH, cp.ALEF_MADDA), (cp.ALEF_HAMZA + cp.MADDAH, cp.ALEF_HAMZA + cp.FATHA + cp.ALEF), (chr(0x657), cp.FATHATAN))
    two = each(one, *((f"{v}({cp.SHADDA}?){m}", f"{n}\\1") for v, m, n in tanween), (f"{cp.TATWEEL}([{marks}]*){cp.HAMZA_ABOVE}", f"{cp.HAMZA}\\1"))
    # a hamza with a vowel of its own after it; one after a sukoon, which stays with its letter; one after other marks, of which the first is its own
    three = each(two, (f"{base}([{other}]*){cp.HAMZA_ABOVE}([{cp.DIACRITICS}])", f"\\1\\2{new}\\3"), (f"{base}([{other}]*){cp.SUKOON}{cp.HAMZA_ABOVE}", f"\\1{cp.SUKOON}{new}\\2"), (f"{base}([{other}]?)([{other}]*){cp.HAMZA_ABOVE}", f"\\1\\3{new}\\2"), (new, cp.HAMZA))
    four = each(three, (f"{cp.SMALL_SEEN}([{cp.WS}]|$)", f"{cp.ZWSP}\\1"), (f"{cp.ALEF_HAMZA}{cp.DAMMA}{cp.WAW}{cp.SUKOON}{cp.LAM}", f"{cp.ALEF_HAMZA}{cp.DAMMA}{cp.WAW}{cp.FATHA}{cp.LAM}"))
    before = f"case when c[i - 1] = {_text(cp.SHADDA)} and i > 2 then c[i - 2] when i > 1 then c[i - 1] end"
    long = f"coalesce((c[i] = {_text(cp.WAW)} and ({before}) = {_text(cp.DAMMA)}) or (c[i] = {_text(cp.YEH)} and ({before}) = {_text(cp.KASRA)}), false)"
    bare = f"{among('c[i]', cp.CONSONANTS)} and not {among('c[i + 1]', marks + cp.MADDAH)} and not {long} and not ({among('c[i + 1]', cp.CONSONANTS)} and not {among('c[i + 2]', marks)})"
    last = each("t", (f"[{cp.ALEF_MADDA}{cp.SUPERSCRIPT_ALEF}]", cp.ALEF), (f"[{cp.OPTIONAL_MARKS}]", ""), (f"{cp.SHADDA}([{cp.VOWELS}])", f"\\1{cp.SHADDA}"))
    return f"""z0 as (select doc_id, translate(text, '{_ALL_FROM}', '{_ALL_TO}') t from {low}),
z8 as (select doc_id, list_filter(string_split({four}, ''), lambda x: x <> '') c from z0),
z10 as (select doc_id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: c[i] || case when {bare} then {_text(cp.SUKOON)} else '' end), '') t from z8),
z as (select doc_id, {last} t from z10)"""


def _drawn_cte() -> str:
    """dr, dg, dc: the rules, rulings and categories of the corpus that is drawn from documents."""
    return f"""dr as (select {', '.join(f'{e} as {c}' for c, e in _DRAWN.items())}, coalesce({_DISPUTE}, false) dispute, {_DISPUTE} and {_SETTLED} settled, {_CORRECTED} corrected, source || ' ' || lang as label from documents),
dg as (select distinct {', '.join(f'{e} as {c}' for c, e in _DRAWN_RULINGS.items())} from (select doc_id % 43 j from documents)),
dc as (select distinct {', '.join(f'{e} as {c}' for c, e in _DRAWN_CATEGORIES.items())} from (select doc_id % 8 i from documents))"""


def oracles() -> dict[str, str]:
    enabled = [r for r in co.DEMO_RULES if r[4] != "disabled"]
    low = "(select doc_id, lower(text) as text, lang, source from documents)"
    fenced = [(r[0], compile_rule(r[2], r[3], LATIN, "re2")) for r in enabled]

    def cte(docs: str = low, k: str = "") -> str:
        """s{k}: the spans of all enabled rules; matches are fenced, places are running sums of the pieces."""
        parts = "\nunion all ".join(f"select doc_id, {_text(i)} rule_id, string_split(regexp_replace(text, {_text(p)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) p from d{k}" for i, p in fenced)
        return f"""d{k} as {docs},
m{k} as ({parts}),
u{k} as (select doc_id, rule_id, unnest(p) x, unnest(range(1, len(p) + 1)) k from m{k}),
o{k} as (select *, coalesce(sum(length(replace(x, chr(2), ''))) over (partition by doc_id, rule_id order by k rows between unbounded preceding and 1 preceding), 0) begun from u{k}),
s{k} as (select doc_id, rule_id, cast(begun as bigint) start_at, cast(begun + instr(x, chr(2)) - 1 as bigint) end_at from o{k} where k > 1)"""

    s = f"with {cte()}"
    category = dict((c, t) for c, t in co.DEMO_CATEGORIES)
    of = {r[0]: r for r in co.DEMO_RULINGS}
    lines = [(r[0], r[1], of[r[1]][1], category[of[r[1]][1]], of[r[1]][2]) for r in enabled]
    line = _values(lines, "rule_id, ruling_id, category_id, topic_id, school")
    count = "select rule_id, count(distinct doc_id) passages, count(*) occurrences from s group by 1"
    told = f"select rule_id, topic_id, coalesce(passages, 0) passages, coalesce(occurrences, 0) occurrences from {line} l left join ({count}) c using (rule_id)"
    other = f"(select doc_id, case when doc_id % 3 = 0 then translate(text, 'é', 'e') when doc_id % 5 = 0 then replace(text, 'the ', 'thy ') else text end as text from {low} where doc_id % 11 <> 3)"
    pattern = {r[0]: compile_rule(r[2], r[3], LATIN, "re2") for r in enabled}
    slices = "select s.*, substring(text, start_at + 1, end_at - start_at) slice from s join d using (doc_id)"
    arms = " ".join(f"when rule_id = {_text(r)} and regexp_matches(slice, {_text(f'^(?:{p})')}) then length(regexp_extract(slice, {_text(f'^(?:{p})')}))" for r, p in _heads("re2"))
    headed = f"select rule_id, length(slice) as was, case {arms} else length(slice) end as becomes from ({slices}) where rule_id in ({', '.join(_text(r) for r, _ in _heads('re2'))})"
    norm = _normalised(low)
    shrinks = "count(*) matches, count_if(becomes < was) shrunk, cast(sum(was) as bigint) code_points_now, cast(sum(becomes) as bigint) code_points_then"
    folded = f"(select doc_id, translate(text, '{_ACCENTED}', '{_FOLDED}') as text from {low})"
    asked = ", ".join(_text(i) for i, n in _NUMBERS if n not in _EXCLUDED + _UNLISTED and i in pattern)
    # r: the spans that show, one list a passage: a span stays that begins at or after the end of the last one that stayed
    kept = "r as (select doc_id, unnest(list_reduce(list_prepend({'free': -1::bigint, 'kept': []::struct(a bigint, z bigint, rule varchar)[]}, l), lambda acc, x: case when x.kept[1].a >= acc.free then {'free': x.free, 'kept': list_concat(acc.kept, x.kept)} else acc end).kept) k from (select doc_id, list({'free': end_at, 'kept': [{'a': start_at, 'z': end_at, 'rule': rule_id}]} order by start_at, end_at desc, rule_id) l from s group by 1)), kr as (select doc_id, k.a start_at, k.z end_at, k.rule rule_id from r)"
    esc = lambda t: f"replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    topics = f"select rule_id, topic_id, ruling_id || ' \u2014 ' || rule_id told from {line}"

    pair = f"pr as (select doc_id, a.text x, b.text y from {low} a full join {other} b using (doc_id))"
    brought = [("alike_folded", "x"), ("alike_accents", "translate(x, 'é', 'e')"), ("alike_vowels", "translate(x, 'éy', 'ee')")]
    edition = lambda docs, name: f"select '{name}' as name, count(*) n, sha256(string_agg(cast(doc_id as varchar) || chr(0) || text, chr(1) order by doc_id)) digest from {docs}"
    row = "select '{}' section, {} as name, cast({} as bigint) reference, cast({} as bigint) other, {} note from {}"
    differ = f"(select doc_id, t, y, list_min(list_filter(range(0, greatest(length(t), length(y)) + 1), lambda i: substring(t, i + 1, 1) <> substring(y, i + 1, 1))) as k from (select doc_id, {brought[-1][1]} t, y from pr) where t <> y)"
    told_report = " union all ".join([
        row.format("passages", "'shared'", "count(x || y)", "null", "null", "pr"), row.format("passages", "'identical'", "count_if(x = y)", "null", "null", "pr"),
        *(row.format("passages", f"'{n}'", f"count_if({e} = y)", "null", "null", "pr") for n, e in brought),
        row.format("passages", "'differing'", "count(*)", "null", "null", differ), row.format("passages", "'normalised_alike'", "count_if(x = y)", "null", "null", "pr"),
        row.format("missing", "cast(doc_id as varchar)", "null", "null", "null", "pr where y is null"), row.format("apart", "cast(doc_id as varchar)", "null", "null", "null", "pr where x <> y"),
        row.format("differing", "cast(doc_id as varchar)", "k", "null", f"{_near('t')} || ' | ' || {_near('y')}", differ),
        row.format("totals", "'rules'", "count(*)", "null", "null", line), row.format("totals", "'spans'", "(select count(*) from s)", "(select count(*) from s2)", "null", "range(1)"),
        row.format("rules", "rule_id", "a", "b", "null", f"(select l.rule_id, (select count(distinct doc_id) from s where s.rule_id = l.rule_id) a, (select count(distinct doc_id) from s2 where s2.rule_id = l.rule_id) b from {line} l) where a <> b"),
        row.format("edition", "name", "n", "null", "digest", f"({edition(low, 'reference')} union all {edition(other, 'other')})"),
    ])

    def froze(docs: str, spans_of: str, version: str, of: str) -> str:
        short = "substring(sha256({}), 1, 16)"
        return f"""select 'corpus' section, '{version}' as name, cast(null as bigint) passages, cast(null as bigint) occurrences, cast(null as varchar) digest
union all select 'edition', name, n, null, digest from ({edition(docs, 'documents')})
union all select 'normalization', cast(doc_id as varchar), null, null, {short.format('text')} from {docs}
union all select 'incidence', rule_id, (select count(distinct doc_id) from {spans_of} q where q.rule_id = l.rule_id), n, {short.format('ids')} from ({_frozen(spans_of, of)}) l"""

    fewer = _values([r for r in lines if r[0] != "th.1"], "rule_id, ruling_id, category_id, topic_id, school")
    drifted = f"(select rule_id, (select count(distinct doc_id) from s where s.rule_id = l.rule_id) e, (select count(distinct doc_id) from s2 where s2.rule_id = l.rule_id and rule_id <> 'pause.1' and (rule_id <> 'wild.1' or doc_id % 3 = 0)) f from {line} l)"

    def drawn(name: str, piece: str, other: str) -> str:
        """The text between spans and the spans, one after another."""
        return f"""{s}, {kept}, q as (select kr.*, topic_id, told, text, substring(text, start_at + 1, end_at - start_at) slice, coalesce(lag(end_at) over (partition by doc_id order by start_at), 0) was from kr join d using (doc_id) join ({topics}) using (rule_id)),
g as (select doc_id, max(end_at) last, string_agg({other.format(t="substring(text, was + 1, start_at - was)")} || {piece}, '' order by start_at) body from q group by 1)
select doc_id, coalesce(body, '') || {other.format(t="substring(text, coalesce(last, 0) + 1)")} {name} from d left join g using (doc_id)"""

    colour = f"case topic_id when 'letters' then '{_HTML['letters']}' when 'sounds' then '{_HTML['sounds']}' else 'currentColor' end"
    element = lambda told: f"'<span class=\"rule\" data-rule=\"' || rule_id || '\" data-topic=\"' || topic_id || '\" style=\"color:' || {colour} || '\" title=\"' || {told} || '\" aria-label=\"' || {told} || '\">' || {esc('slice')} || '</span>'"
    drawn_cte = _drawn_cte()
    lined = "select dr.id rule_id, ruling ruling_id, category category_id, topic topic_id, coalesce(school, '') school, status from dr left join dg on dg.id = ruling left join dc on dc.id = category"
    return {
        "edition_report": f"{s}, {cte(other, '2')}, {pair} {told_report}",
        "edition_frozen": f"{s} {froze(low, 's', '1', line)}",
        "edition_regression": f"{s}, {cte(other, '2')}, was as ({froze(low, 's', '1', line)}), now as ({froze(other, 's2', '2', fewer)}) select section, name, case when b is null then 'not frozen' when c is null then 'gone' when was.digest is distinct from now.digest then 'digest' when was.passages is distinct from now.passages then 'passages' when was.occurrences is distinct from now.occurrences then 'occurrences' end fault from (select *, 1 b from was) was full join (select *, 1 c from now) now using (section, name) where fault is not null",
        "edition_check": f"{s}, {cte(other, '2')}, e as (select translate(text, 'q', '{cp.FATHA}') text from {other}) select 'problem' severity, 'riwayah' fault, 'other' about union all select 'warning', 'count', cast(count(*) as varchar) from e having count(*) <> 1000 union all select 'problem', 'missing', 'a mark' union all select 'problem', 'unknown mark', 'U+064E' where (select count(*) from e where contains(text, '{cp.FATHA}')) > 0 union all select 'warning', 'composed', 'U+00DF' where (select count(*) from e where contains(text, 'ß')) > 0 union all select case when f = 0 then 'problem' else 'warning' end, 'rule', rule_id from {drifted} where e >= 20 and (f < 0.5 * e or f > 2 * e)",
        "span_once": f"{s} select * from s",
        "resolve_overlaps": f"{s}, {kept} select * from kr",
        "html_render": drawn("html", element("told"), esc("{t}")),
        "html_described": drawn("html", element(esc("case when length(slice) > 2 then slice || ': ' || length(slice) else told end")), esc("{t}")),
        "ansi_render": drawn("ansi", f"case topic_id when 'letters' then chr(27) || '[38;5;{_TERMINAL['letters']}m' when 'sounds' then chr(27) || '[38;5;{_TERMINAL['sounds']}m' else '' end || slice || chr(27) || '[0m'", "{t}"),
        "passage_summary": f"{s}, {kept}, v as (select doc_id, ruling_id, min((start_at, -end_at, rule_id)) f from kr join {line} using (rule_id) group by 1, 2), sn as (select doc_id, string_agg(ruling_id, ',' order by f) seen from v group by 1) select doc_id, count(*) spans, count(distinct ruling_id) rulings, any_value(seen) seen from s join {line} using (rule_id) join sn using (doc_id) group by 1",
        "older_spans": f"with {_older_cte()} select *, false faulty from older union all select null, 'broken.1', null, null, null, true",
        "older_agreement": f"with {cte(folded)}, {_older_cte()}, a as (select distinct rule_id, doc_id, 1 x from s where rule_id in ({asked})), b as (select distinct rule_id, doc_id, 1 y from older where rule_id in ({asked})) select rule_id, count(x + y) \"both\", count_if(y is null) only_ours, count_if(x is null) only_theirs from a full join b using (rule_id, doc_id) group by 1",
        "older_differential": f"with {cte(folded)}, {_older_cte()}, t as (select distinct doc_id, rule_id, start_at, end_at, 1 y from older where start_at is not null and rule_id in ({asked})), a as (select s.*, 1 x from s where (doc_id, rule_id) in (select (doc_id, rule_id) from t)) select rule_id, count(x + y) \"both\", count_if(y is null) only_ours, count_if(x is null) only_theirs from a full join t using (doc_id, rule_id, start_at, end_at) group by 1",
        "start_from_study": f"{s} select rule_id, {shrinks} from ({headed}) group by 1",
        "start_from_total": f"{s} select {shrinks} from ({headed})",
        "rule_incidence": f"{s} {told}",
        "span_extract": f"{s} select * from s",
        "span_native": f"{s} select * from s",
        "pack_unpack": f"{s} select * from s",
        "span_slice": f"{s} select s.*, substring(text, start_at + 1, end_at - start_at) slice from s join d using (doc_id)",
        "matches_flag": "select doc_id, " + ", ".join(f"regexp_matches(text, {_text(p)}) {r.replace('.', '_')}" for r, p in pattern.items()) + f", false none_1 from {low}",
        "only_filter": f"{s} select * from ({told}) where rule_id in (select rule_id from {line} where category_id = 'joined' or rule_id = 'vowel.1')",
        "school_filter": f"{s} select * from ({told}) where rule_id in (select rule_id from {line} where school is null or school = 'north')",
        "incidence_digest": f"{s} select rule_id, substring(sha256(coalesce(ids, '')), 1, 16) digest from {line} l left join ({_refs('s')}) using (rule_id)",
        "summary_per_doc": f"{s} select doc_id, count(*) spans, count(distinct rule_id) rules from s group by 1",
        "first_appearance": f"{s} select doc_id, rule_id, count(*) n, min(start_at) first_at from s group by 1, 2",
        "lineage_rollup": f"{s} select topic_id, category_id, ruling_id, rule_id, count(*) n from s join {line} l using (rule_id) group by rollup (topic_id, category_id, ruling_id, rule_id)",
        "many_rules": "select rule_id, 'pairs' topic_id, cast(count_if(n > 0) as bigint) passages, cast(sum(n) as bigint) occurrences from (" + " union all ".join(f"select '{i}' rule_id, len(regexp_extract_all(text, {_text(compile_rule(case, scope, LATIN, 're2'))})) n from {low}" for i, case, scope in MANY_RULES) + ") group by 1",
        "norm_letters": f"with {_all_passes(low)} select doc_id, t norm_text, cast(length(t) as integer) n from z",
        "status_counts": f"with {drawn_cte} select status, count(*) n from dr group by 1",
        "gaps": f"with {drawn_cte} select gap, count(*) n, arg_min(reason, id) reason, string_agg(id, ',' order by id) ids from dr where status = 'disabled' group by 1",
        "rule_search": f"with {drawn_cte} select id, ruling from dr where contains(lower(id), 'r1') or contains(lower(ruling), 'r1') or contains(label, 'R1')",
        "constraints": f"with {drawn_cte} " + " union all ".join(f"select '{gate}' gate, id from {of}" for gate, of in {
            "unique-rule": "(select id from dr group by 1 having count(*) > 1)", "unique-ruling": "(select id from dg group by 1 having count(*) > 1)", "unique-category": "(select id from dc group by 1 having count(*) > 1)",
            "rule-without-ruling": "dr where ruling not in (select id from dg)", "ruling-without-category": "dg where category not in (select id from dc)", "ruling-without-rule": "dg where id not in (select ruling from dr)",
            "namespace": "dr where not starts_with(id, ruling || '.')", "scope": "dr where not contains(pattern_case, '+') and scope <> 'within-word' and gap is distinct from 'not-a-pattern'",
            "brackets": "dr where length(replace(pattern_case, ']', '')) <> length(replace(pattern_case, '[', '')) and gap is distinct from 'not-a-pattern'",
            "gap-status": "dr where status = 'disabled' and gap is null or status = 'stable' and gap is not null", "open-dispute-stable": "dr where dispute and not settled and status = 'stable'",
            "disputed-without-record": "dr where status = 'disputed' and not dispute", "settled-but-disputed": "dr where status = 'disputed' and dispute and settled", "corrected-without-review": "dr where corrected and not needs_review",
            "stripped-mark": f"dr where gap is distinct from 'not-a-pattern' and subject <> 'original' and contains(pattern_case, '{cp.SMALL_WAW}')", "id-form": "dr where not regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*\\.[0-9]+')",
        }.items()),
        "lineage_strict": "select r_name, n_name, count(*) customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
        "lineage_left": "select n_name, count(s_suppkey) suppliers from nation left join supplier on n_nationkey = s_nationkey group by 1",
        "edition_digest": f"select lang, count(*) passages, sha256(string_agg(cast(doc_id as varchar) || chr(0) || text, chr(1) order by doc_id)) digest from {low} group by 1",
        "edition_compare": f"with b as (select a.text a, b.text b from {low} a join {other} b using (doc_id)) select count(*) shared, count_if(a = b) identical, count_if(a = b) alike_folded, count_if(translate(a, 'é', 'e') = b) alike_accents, count_if(translate(a, 'éy', 'ee') = b) alike_vowels from b",
        "edition_only_left": f"select doc_id from {low} where doc_id not in (select doc_id from {other})",
        "first_difference": f"with p as (select doc_id, a.text x, b.text y, list_min(list_filter(range(0, greatest(length(a.text), length(b.text)) + 1), lambda i: substring(a.text, i + 1, 1) <> substring(b.text, i + 1, 1))) as k from {low} a join {other} b using (doc_id) where a.text <> b.text) select doc_id, cast(k as bigint) as at, {_near('x')} left_near, {_near('y')} right_near from p",
        "char_census": " union all ".join(f"select '{c}' ch, cast(sum(length(text) - length(replace(text, '{c}', ''))) as bigint) n from {low}" for c in "aeéüñ."),
        "unknown_chars": f"select ch, count(*) n from (select unnest(string_split(regexp_replace(text, '[a-z0-9 .,\\n]', '', 'g'), '')) ch from {low}) where ch <> '' group by 1",
        "drift_check": f"{s}, b as (select rule_id, count(distinct doc_id) filter (where doc_id % 2 = 0) expected, count(distinct doc_id) filter (where doc_id % 2 = 1) found from {line} l left join s using (rule_id) group by 1) select rule_id, expected, found, case when expected < 20 then 'ok' when found = 0 then 'problem' when found < 0.5 * expected or found > 2 * expected then 'warning' else 'ok' end severity from b",
        "expectations": f"{s}, h as (select distinct doc_id from s where rule_id = 'pair.2') select 'pair.2' rule_id, doc_id, 'missing' fault from labels where quality = 1 and doc_id not in (select doc_id from h) union all select 'pair.2', doc_id, 'unwanted' from labels where not quality = 1 and doc_id in (select doc_id from h)",
        "differential_span": f"{s}, {cte(other, '2')} select rule_id, count(s.doc_id + s2.doc_id) \"both\", count_if(s2.doc_id is null) only_ours, count_if(s.doc_id is null) only_theirs from s full join s2 using (doc_id, rule_id, start_at, end_at) group by 1",
        "frozen_regression": f"select doc_id, substring(sha256(a.text), 1, 16) frozen, substring(sha256(b.text), 1, 16) actual from {low} a left join {other} b using (doc_id) where substring(sha256(a.text), 1, 16) is distinct from substring(sha256(b.text), 1, 16)",
        "zero_width": f"{s} select rule_id, count(*) n from s where end_at <= start_at group by 1",
        "positional_import": "select item_id ref, array_to_string(list_transform(string_split(text, ' '), lambda w, i: case when i % 5 = 3 then '+ ~ ' else '' end || w || case when i % 7 = 4 then '*' else '' end), ' ') text from benchmark",
        "stable_filter": f"{s} select * from ({told}) where rule_id in ({', '.join(_text(r[0]) for r in enabled if r[4] == 'stable')})",
        "topic_toggle": f"{s} select * from ({told}) where topic_id = 'sounds'",
        "review_marks": f"with {drawn_cte} select id, case when status = 'disabled' then 'x' when status = 'disputed' then '!' when needs_review then '?' else ' ' end mark from dr",
        "rules_standing": f"with {drawn_cte} select count(*) rules, count_if(status = 'disabled') disabled, count_if(status = 'disputed') disputed, count_if(needs_review) in_review from dr",
        "rule_lineage": f"with {drawn_cte} {lined}",
        "explain_rule": f"with {drawn_cte} select dr.id, topic topic_id, category category_id, ruling ruling_id, school, pattern_case, scope, subject, status, gap, reason, needs_review from dr left join dg on dg.id = ruling left join dc on dc.id = category where dr.id = 'r9.9'",
        "incidence_change": f"{s}, {cte(other, '2')}, c1 as ({told}), c2 as (select rule_id, count(distinct doc_id) other from s2 group by 1) select rule_id, passages reference, coalesce(other, 0) other, coalesce(other, 0) - passages delta from c1 left join c2 using (rule_id)",
        "pinned_counts": f"{s}, w as (select * from (values {', '.join('(' + ', '.join(_text(x) if isinstance(x, str) else 'null' if x is None else str(x) for x in r) + ')' for r in _PINNED)}) t(rule_id, p, o)), c as ({told}) select rule_id, case when c.rule_id is null then 'no such rule' when p <> passages then 'passages' when o <> occurrences then 'occurrences' end fault from w left join c using (rule_id) where fault is not null",
        "rule_samples": f"{s} select * from (select rule_id, doc_id, row_number() over (partition by rule_id order by doc_id) nth from (select distinct rule_id, doc_id from s)) where nth <= 5",
        "frozen_rules": f"{s}, {cte(other, '2')}, a as ({_frozen('s', line)}), b as ({_frozen('s2', line)}) select rule_id, case when a.ids <> b.ids then 'digest' when a.n <> b.n then 'occurrences' end fault from a join b using (rule_id) where fault is not null",
        "ill_formed_spans": f"{s} select doc_id, rule_id, start_at, end_at, 'past the end' fault from s join d using (doc_id) where end_at > length(replace(text, ' ', ''))",
        "unequal_editions": f"with a as (select doc_id, substring(sha256(text), 1, 16) digest from {low}), b as (select doc_id, substring(sha256(text), 1, 16) digest from {other}) select *, 'left' side from (from a except all from b) union all select *, 'right' from (from b except all from a)",
        "rule_agreement": f"{s}, {cte(other, '2')}, a as (select distinct rule_id, doc_id, 1 x from s where rule_id not in ('th.1', 'th.2')), b as (select distinct rule_id, doc_id, 1 y from s2 where rule_id not in ('th.1', 'th.2')) select rule_id, count(x + y) \"both\", count_if(y is null) only_ours, count_if(x is null) only_theirs from a full join b using (rule_id, doc_id) group by 1",
        "annotated_refs": f"{s} select concat_ws(':', doc_id // 100 + 1, doc_id % 100 + 1) as ref, doc_id in (select doc_id from s) annotated from d",
        "annotation_totals": f"{s} select count(*) passages, count_if(doc_id in (select doc_id from s)) annotated, (select count(*) from s) spans from d",
        "ayah_lists": "select doc_id // 100 surah, string_agg(cast(doc_id % 100 as varchar), ',' order by doc_id) ayahs from documents group by 1",
        "code_point_dump": f"select item_id, array_to_string(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: (case when c = ' ' then '{chr(0x2423)}' else c end) || '=' || printf('%04X', unicode(c))), ' ') dump from benchmark",
        "table_function": "with p as (select item_id, string_split(regexp_replace(text, '[aeiou]+t', chr(1) || '\\0' || chr(2), 'g'), chr(1)) p from benchmark), u as (select item_id, unnest(p) x, unnest(range(1, len(p) + 1)) k from p), o as (select *, coalesce(sum(length(replace(x, chr(2), ''))) over (partition by item_id order by k rows between unbounded preceding and 1 preceding), 0) b from u) select item_id, cast(b as bigint) start_at, cast(b + instr(x, chr(2)) - 1 as bigint) end_at from o where k > 1",
        "expected_chars": " union all ".join(f"select {_text(name)} as name, n found, case when n > 0 then 'present' else '{'absent' if optional else 'missing'}' end state from (select cast(sum(length(text) - length(replace(text, '{c}', ''))) as bigint) n from {low})" for c, name, optional in _EXPECTED),
        "byte_offsets": f"{s}, p as (select distinct doc_id, unnest([start_at, end_at]) k from s) select doc_id, cast(strlen(substring(text, 1, k)) as bigint) as byte, k as at from p join d using (doc_id)",
        "norm_full": f"with {norm} select doc_id, t norm_text, cast(length(t) as integer) n from n13",
        "unknown_marks": f"with {norm}, b as (select unnest(string_split(t, '')) ch from n0), a as (select unnest(string_split(t, '')) ch from n13) select ch, count(*) n, any_value(survived) survived from b join (select ch, count(*) survived from a group by 1) using (ch) where regexp_matches(ch, '[{editions.WIDE_MARKS}]') and ch not in ('{cp.FATHA}', '{cp.DAMMA}', '{cp.SUKOON}') group by 1",
        "fold_marks": f"with {norm} select doc_id, array_to_string(list_transform(regexp_extract_all(t, '[^{editions.WIDE_MARKS}][{editions.WIDE_MARKS}]*|^[{editions.WIDE_MARKS}]+'), lambda x: case when regexp_matches(substring(x, 1, 1), '[{editions.WIDE_MARKS}]') then x else substring(x, 1, 1) || array_to_string(list_sort(string_split(substring(x, 2), '')), '') end), '') folded from n0",
        "norm_strip": f"select doc_id, translate(translate(text, 'aeio', 'ۥۦـٓ'), '{cp.OPTIONAL_MARKS}', '') stripped from {low}",
    }
