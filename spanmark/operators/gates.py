"""Quality gates: each is a query whose rows are violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmark.functions import codepoints as cp
from spanmark.functions.notation import Profile, parse
from spanmark.operators import digests


def violations(corpus: dict[str, DataFrame]) -> DataFrame:
    """gate, id of everything in a corpus that its invariants forbid."""
    rules, rulings, categories, topics = corpus["rules"], corpus["rulings"], corpus["categories"], corpus.get("topics")
    dispute, settled = F.col("disputed").isNotNull(), F.col("disputed.resolved_by").isNotNull()

    def told(gate: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(gate).alias("gate"), F.col("id").cast("string").alias("id"))

    twice = lambda df: df.groupBy("id").count().where("count > 1")
    groups = F.size(F.split("pattern_case", r"\+"))
    depth = F.aggregate(F.split("pattern_case", ""), F.lit(0), lambda d, c: F.when((d < 0) | (d > 1), d).otherwise(d + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)))
    out = [
        told("unique-rule", twice(rules)), told("unique-ruling", twice(rulings)), told("unique-category", twice(categories)),
        told("rule-without-ruling", rules.join(rulings.select(F.col("id").alias("ruling")), "ruling", "left_anti")),
        told("ruling-without-category", rulings.join(categories.select(F.col("id").alias("category")), "category", "left_anti")),
        told("ruling-without-rule", rulings.join(rules.select(F.col("ruling").alias("id")), "id", "left_anti")),
        told("namespace", rules.where(~F.col("id").startswith(F.concat("ruling", F.lit("."))))),
        told("scope", rules.where((groups == 1) & (F.col("scope") != "within-word") & ~F.col("gap").eqNullSafe("not-a-pattern"))),
        told("brackets", rules.where((depth != 0) & ~F.col("gap").eqNullSafe("not-a-pattern"))),
        told("gap-status", rules.where((F.col("status") == "disabled") & F.col("gap").isNull() | (F.col("status") == "stable") & F.col("gap").isNotNull())),
        told("open-dispute-stable", rules.where(dispute & ~settled & (F.col("status") == "stable"))),
        told("disputed-without-record", rules.where((F.col("status") == "disputed") & ~dispute)),
        told("settled-but-disputed", rules.where((F.col("status") == "disputed") & settled)),
        told("corrected-without-review", rules.where(F.col("corrections").isNotNull() & ~F.col("needs_review"))),
        told("stripped-mark", rules.where(~F.col("gap").eqNullSafe("not-a-pattern") & (F.col("subject") != "original") & (F.size(stripped_marks(F.col("pattern_case"))) > 0))),
        told("id-form", rules.where(~F.col("id").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\.[0-9]+\z"))),
    ]
    if topics is not None:
        out += [told("unique-topic", twice(topics)), told("category-without-topic", categories.join(topics.select(F.col("id").alias("topic")), "topic", "left_anti"))]
    return reduce(DataFrame.union, out)


def stripped_marks(case: Column) -> Column:
    """The marks of a pattern, names spelt out, that normalisation strips and so never finds; the wildcard is none."""
    for name, mark in cp.NAMED_MARKS.items():
        case = F.replace(case, F.lit(name), F.lit(mark))
    return F.array_intersect(F.split(case, ""), F.array(*map(F.lit, cp.OPTIONAL_MARKS.replace(cp.TATWEEL, ""))))


def undescribed(rules: DataFrame, checks: list[tuple[str, list[str], str]], language: str, profile: Profile, sakin: str = "") -> DataFrame:
    """id, check: enabled rules whose label has one of a check's phrases while no alternative is one of its letters,
    bare or followed by `sakin`. checks: name, phrases, letters. Patterns are a few hundred and parsed on the driver."""
    rows = rules.where("status <> 'disabled'").select("id", "pattern_case", F.coalesce(F.col("label")[language], F.lit("")).alias("label"))
    parsed = [(r["id"], r["label"], [a for group in parse(r["pattern_case"], profile) for a in group]) for r in rows.collect()]
    rows = rules.sparkSession.createDataFrame(parsed, "id string, label string, alternatives array<string>")
    told = []
    for name, phrases, letters in checks:
        mentioned = F.exists(F.array(*map(F.lit, phrases)), lambda x: F.contains(F.col("label"), x))
        wanted = F.array(*(F.lit(x + end) for x in letters for end in dict.fromkeys(("", sakin))))
        told.append(rows.where(mentioned).where(~F.arrays_overlap("alternatives", wanted)).select("id", F.lit(name).alias("check")))
    return reduce(DataFrame.union, told)


def pinned(spans: DataFrame, lines: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """rule_id, fault of wanted (rule_id, passages, occurrences; null: any number) that don't hold, or whose rule isn't there."""
    told = spans.groupBy("rule_id", key).agg(F.count(F.lit(1)).alias("n")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("has_passages"), F.sum("n").alias("has_occurrences"))
    known = lines.select("rule_id", F.lit(True).alias("known"))
    both = wanted.join(known, "rule_id", "left").join(told, "rule_id", "left").fillna(0, ["has_passages", "has_occurrences"])
    fault = F.when(F.col("known").isNull(), "no such rule").when(F.col("passages") != F.col("has_passages"), "passages").when(F.col("occurrences") != F.col("has_occurrences"), "occurrences")
    return both.select("rule_id", fault.alias("fault")).where("fault is not null")


def samples(spans: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """The first `most` passages of each rule: rule_id, key, nth."""
    nth = F.row_number().over(Window.partitionBy("rule_id").orderBy(key))
    return spans.select("rule_id", key).distinct().withColumn("nth", nth).where(F.col("nth") <= most).select("rule_id", key, F.col("nth").cast("long").alias("nth"))


def frozen(spans: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a rule's matches are frozen as: rule_id, passages, occurrences and the digest of the passages' keys."""
    return frozen_of(spans.groupBy("rule_id", key).agg(F.count(F.lit(1)).alias("n")), lines, key)


def frozen_of(counts: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same from the counts of `spans.counted`, which are read once for numbers and digest."""
    per = counts.groupBy("rule_id", key).agg(F.sum("n").alias("n"))
    found = digests.flat(per, ["rule_id"], [key], F.col(key), ",", F.col("n"))
    told = lines.select("rule_id").join(found, "rule_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return told.select("rule_id", zero("n").alias("passages"), zero("weight").alias("occurrences"), F.substring(F.coalesce("digest", F.sha2(F.lit(""), 256)), 1, 16).alias("digest"))


def thawed(old: DataFrame, new: DataFrame) -> DataFrame:
    """rule_id, fault where two frozen tables disagree: a rule of one that the other hasn't, another digest, or the
    same passages with another number of occurrences."""
    o, n = old.select("rule_id", *(F.col(c).alias(f"old_{c}") for c in ("digest", "occurrences"))), new.select("rule_id", *(F.col(c).alias(f"new_{c}") for c in ("digest", "occurrences")))
    fault = F.when(F.col("old_digest").isNull(), "not frozen").when(F.col("new_digest").isNull(), "gone").when(F.col("old_digest") != F.col("new_digest"), "digest").when(F.col("old_occurrences") != F.col("new_occurrences"), "occurrences")
    return o.join(n, "rule_id", "full").select("rule_id", fault.alias("fault")).where("fault is not null")


def ill_formed(spans: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans that begin before their passage or end before they begin ("range"), end after it ("past the end") or cover nothing ("empty")."""
    both = spans.join(passages.select(key, F.length(text).alias("size")), key)
    fault = F.when((F.col("start_at") < 0) | (F.col("end_at") < F.col("start_at")), "range").when(F.col("end_at") > F.col("size"), "past the end").when(F.col("end_at") == F.col("start_at"), "empty")
    return both.select(key, "rule_id", "start_at", "end_at", fault.alias("fault")).where("fault is not null")


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one set that the other hasn't, with `side`; none if the sets are equal."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def agreement(ours: DataFrame, theirs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per rule how many passages both sides match, only ours, only theirs. theirs has `their_id`, which ids
    (rule_id, their_id) translates; what has no translation is left out."""
    mine = ours.select("rule_id", key).distinct().join(F.broadcast(ids.select("rule_id")), "rule_id", "left_semi").withColumn("ours", F.lit(1))
    other = theirs.join(F.broadcast(ids), "their_id").select("rule_id", key).distinct().withColumn("theirs", F.lit(1))
    j = mine.join(other, ["rule_id", key], "full")
    return j.groupBy("rule_id").agg(F.count(F.col("ours") + F.col("theirs")).alias("both"), F.count_if(F.col("theirs").isNull()).alias("only_ours"), F.count_if(F.col("ours").isNull()).alias("only_theirs"))


def drift(baseline: DataFrame, actual: DataFrame, low: float = 0.5, high: float = 2.0, least: int = 20) -> DataFrame:
    """rule_id, passages that it matches in both, severity: of rules that matched at least `least` passages, one that matches none is a
    problem and one that matches far less or more a warning."""
    b = baseline.select("rule_id", F.col("passages").alias("expected"))
    both = b.join(actual.select("rule_id", F.col("passages").alias("found")), "rule_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    ratio = F.try_divide("found", "expected")
    severity = F.when(F.col("expected") < least, "ok").when(F.col("found") == 0, "problem").when((ratio < low) | (ratio > high), "warning").otherwise("ok")
    return both.select("rule_id", "expected", "found", severity.alias("severity"))


def expectations(spans: DataFrame, pinned: DataFrame, key: str = "doc_id") -> DataFrame:
    """pinned (rule_id, key, wanted boolean): rows that must have a match and have none, or must not and do."""
    have = spans.select("rule_id", key).distinct()
    missing = pinned.where("wanted").join(have, ["rule_id", key], "left_anti").select("rule_id", key, F.lit("missing").alias("fault"))
    return missing.union(pinned.where("not wanted").join(have, ["rule_id", key], "left_semi").select("rule_id", key, F.lit("unwanted").alias("fault")))


def differential(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Per rule how many spans both have, only ours, only theirs: a full outer join on all keys."""
    a, b = ours.select(*keys).distinct().withColumn("ours", F.lit(1)), theirs.select(*keys).distinct().withColumn("theirs", F.lit(1))
    j = a.join(b, keys, "full")
    return j.groupBy("rule_id").agg(F.count(F.col("ours") + F.col("theirs")).alias("both"), F.count_if(F.col("theirs").isNull()).alias("only_ours"), F.count_if(F.col("ours").isNull()).alias("only_theirs"))


def start_from(slices: DataFrame, heads: list[tuple[str, str]], total: bool = False) -> DataFrame:
    """Would spans shrink if they covered only what a rule's head (rule_id, pattern of the Java dialect) matches at
    their beginning? Per rule with a head, or in total: matches, how many shrink, code points now and then. A span
    that its head doesn't match stays as long as it is."""
    head = F.lit(None).cast("string")
    for rule, pattern in heads:
        found = F.when(F.regexp_like("slice", F.lit(f"^(?:{pattern})")), F.regexp_extract("slice", f"^(?:{pattern})", 0)).otherwise(F.col("slice"))
        head = F.when(F.col("rule_id") == rule, found).otherwise(head)
    rows = slices.where(F.col("rule_id").isin([r for r, _ in heads])).select("rule_id", F.length("slice").alias("now"), F.length(head).alias("then"))
    told = [F.count(F.lit(1)).alias("matches"), F.count_if(F.col("then") < F.col("now")).alias("shrunk"), F.sum("now").alias("code_points_now"), F.sum("then").alias("code_points_then")]
    return rows.agg(*told) if total else rows.groupBy("rule_id").agg(*told)
