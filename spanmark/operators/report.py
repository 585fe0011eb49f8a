"""What lies between two editions, and what an edition was frozen as: each one table of rows, which the document sink writes as one file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmark.functions.normalize import normalized
from spanmark.operators import editions, gates, spans
from spanmark.operators.editions import brought, folded

ROW = "section string, name string, reference long, other long, note string"
ORDER = ["section", "reference", "name"]


def _row(section: str, name: Column | str, reference: Column | None = None, other: Column | None = None, note: Column | None = None) -> list[Column]:
    none = F.lit(None)
    name = F.lit(name) if isinstance(name, str) else name.cast("string")
    return [F.lit(section).alias("section"), name.alias("name"), (none if reference is None else reference).cast("long").alias("reference"), (none if other is None else other).cast("long").alias("other"), (none if note is None else note).cast("string").alias("note")]


def paired(left: DataFrame, right: DataFrame, ref: str) -> DataFrame:
    """ref, text, other of all passages of two editions; a null where an edition hasn't the passage."""
    return left.select(ref, "text").join(right.select(ref, F.col("text").alias("other")), ref, "full")


def between(pairs: DataFrame, ref: str, classes: list[tuple[str, str, str]], lines: DataFrame, rules: list[tuple[str, str]], original: frozenset[str] = frozenset()) -> DataFrame:
    """section, name, reference, other, note of the distance between two editions (ref, text, other):

    passages   shared, identical, alike_folded, alike_<class> (each with all classes before it), differing, normalised_alike: how many
    missing    passages that only the reference has
    differing  passages that are not alike once both are folded and the left has all classes: where (reference), and the code points around it (note: left, then right)
    apart      shared passages that don't reach the matchers as the same string
    totals     rules that were run, and spans in both
    rules      passages that a rule matches in both, where the numbers differ
    edition    each edition's digest

    Both texts of a passage are folded, normalised and matched in passes over the same rows. No clock is in it, so the same editions give the same
    rows. A null text counts as a passage that the edition hasn't."""
    shared = pairs.where("text is not null and other is not null")
    left = [folded(F.col("text")), *(folded(brought(F.col("text"), classes[: k + 1])) for k in range(len(classes)))]
    right, names = folded(F.col("other")), ["alike_folded", *(f"alike_{c}" for c, _, _ in classes)]
    one = shared.agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("text") == F.col("other")).alias("identical"), *(F.count_if(x == right).alias(n) for x, n in zip(left, names, strict=True)))
    unlike = shared.where("text <> other")
    both = normalized(normalized(unlike.select(ref, "text", "other"), "text", "left"), "other", "right")
    apart = both.where("left_text <> right_text").select(ref)
    texts = shared.select(ref, left[-1].alias("x"), right.alias("y")).where("x <> y")
    left_over = editions.first_differences(texts, [ref], "x", "y")
    counts = spans.counted(pairs, rules, [ref], "text", original, "other")
    per = counts.groupBy("rule_id").agg(F.count_if(F.col("n") > 0).alias("a"), F.count_if(F.col("n_other") > 0).alias("b"), F.sum("n").alias("m"), F.sum("n_other").alias("m_other"))
    told = lines.select("rule_id").join(per, "rule_id", "left").fillna(0)
    numbers = one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in ("shared", "identical", *names)))))
    sides = [pairs.where(f"{c} is not null").select(F.lit(e).alias("edition"), ref, F.col(c).alias("text")) for e, c in (("reference", "text"), ("other", "other"))]
    digest = editions.digest(sides[0].unionByName(sides[1]), "edition", ref, "text")
    out = [
        numbers.select(*_row("passages", F.col("name"), F.col("n"))),
        left_over.agg(F.count(F.lit(1)).alias("n")).select(*_row("passages", "differing", F.col("n"))),
        one.crossJoin(apart.agg(F.count(F.lit(1)).alias("n"))).select(*_row("passages", "normalised_alike", F.col("shared") - F.col("n"))),  # one row each
        pairs.where("text is not null and other is null").select(*_row("missing", F.col(ref))),
        left_over.select(*_row("differing", F.col(ref), F.col("at"), None, F.concat_ws(" | ", "left_near", "right_near"))),
        apart.select(*_row("apart", F.col(ref))),
        told.agg(F.count(F.lit(1)).alias("n")).select(*_row("totals", "rules", F.col("n"))),
        told.agg(F.sum("m").alias("m"), F.sum("m_other").alias("o")).select(*_row("totals", "spans", F.col("m"), F.col("o"))),
        told.where("a <> b").select(*_row("rules", F.col("rule_id"), F.col("a"), F.col("b"))),
        digest.select(*_row("edition", F.col("edition"), F.col("passages"), None, F.col("digest"))),
    ]
    return reduce(DataFrame.unionByName, out)


def frozen(passages: DataFrame, ref: str, lines: DataFrame, rules: list[tuple[str, str]], version: str, edition: str, original: frozenset[str] = frozenset()) -> DataFrame:
    """section, name, passages, occurrences, digest of an edition as a corpus annotates it, digests only and no text:

    corpus         its version (name)
    edition        its name, number of passages and digest
    normalization  16 digits of the SHA-256 of each passage's normalised text
    incidence      of each rule the passages and occurrences that it matches, and the digest of the passages' references"""
    none = F.lit(None)
    row = lambda section, name, p=none, o=none, d=none: [F.lit(section).alias("section"), name.cast("string").alias("name"), p.cast("long").alias("passages"), o.cast("long").alias("occurrences"), d.cast("string").alias("digest")]
    whole = editions.digest(passages.select(F.lit(edition).alias("edition"), ref, "text"), "edition", ref, "text")
    norm = normalized(passages.select(ref, "text"), "text")
    per = gates.frozen_of(spans.counted(passages, rules, [ref], original=original), lines, ref)
    out = [
        passages.sparkSession.range(1).select(*row("corpus", F.lit(version))),
        whole.select(*row("edition", F.col("edition"), F.col("passages"), none, F.col("digest"))),
        norm.select(*row("normalization", F.col(ref), none, none, F.substring(F.sha2("norm_text", 256), 1, 16))),
        per.select(*row("incidence", F.col("rule_id"), F.col("passages"), F.col("occurrences"), F.col("digest"))),
    ]
    return reduce(DataFrame.unionByName, out)


FROZEN = "section string, name string, passages long, occurrences long, digest string"


def regression(old: DataFrame, new: DataFrame) -> DataFrame:
    """section, name, fault where a frozen table no longer holds: another corpus version or edition, an entry that is gone or not
    frozen, another digest, the same digest with other numbers."""
    values = ["passages", "occurrences", "digest"]
    side = lambda df, p: df.select("section", "name", F.struct(*values).alias(p))
    both = side(old, "old").join(side(new, "new"), ["section", "name"], "full")
    fault = (
        F.when(F.col("old").isNull(), "not frozen").when(F.col("new").isNull(), "gone")
        .when(~F.col("old.digest").eqNullSafe(F.col("new.digest")), "digest")
        .when(~F.col("old.passages").eqNullSafe(F.col("new.passages")), "passages")
        .when(~F.col("old.occurrences").eqNullSafe(F.col("new.occurrences")), "occurrences")
    )
    return both.select("section", "name", fault.alias("fault")).where("fault is not null")
