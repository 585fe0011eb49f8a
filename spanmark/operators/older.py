"""Annotation as the older engine did it: spans of rules in the older dialect, found again in the text itself."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmark.functions.normalize import in_parts, is_touched, normalized_batch
from spanmark.functions.notation import char_class
from spanmark.functions.older import Finder, Older, compiled, fragments_of

ROWS_AT_ONCE = 100_000


def collected(passages: DataFrame, rules: list[tuple[str, str, str]], keys: list[str], script: Older, text: str = "text", subject: str | None = None, trailing: bool = True) -> DataFrame:
    """keys, rule_id, nth, start_at, end_at, fault: the spans of rules (rule_id, case, white space) in the text, in the older engine's order.

    A rule is matched on `subject`, a column with the normalised text (by default normalised here). Each distinct text that it matches, in
    the order in which they come, is looked for in the text itself, whatever stands around it; so equal spans can come twice, and what a
    match doesn't lead back to is no span. trailing: a span takes the marks after it along. A rule that matches a passage in which
    nothing is found again has one row there, without a span. A rule whose pattern is none has one row without a passage, with the reason
    as its fault. A null text has no rows. One Arrow pass, no shuffle."""
    good, bad = compiled(rules, script)
    marks = re.compile(f"{char_class(script.trailing)}*")
    rows = passages.select(*keys, F.col(text).alias("the text"), (F.col(subject) if subject else F.lit(None).cast("string")).alias("the subject"))

    def told(texts: list[str], subjects: list[str]) -> Iterator[tuple[int, str, int, int | None, int | None]]:
        matched = [list(fragments_of(t, s, good)) for t, s in zip(texts, subjects, strict=True)]
        finder = Finder((f for of in matched for _, hits, as_is in of if not as_is for f in hits), script)
        for k, (t, of) in enumerate(zip(texts, matched, strict=True)):
            places = finder.found(t, {f for _, hits, as_is in of if not as_is for f in hits})
            for rule_id, hits, as_is in of:
                nth = 0
                for f in hits:
                    for a, z in ((m.span() for m in re.finditer(re.escape(f), t)) if as_is else places[f]):
                        nth += 1
                        yield k, rule_id, nth, a, marks.match(t, z).end() if trailing else z
                if not nth:
                    yield k, rule_id, 0, None, None

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts, subjects = b["the text"].to_pylist(), b["the subject"].to_pylist()
            for begin, stop in in_parts(all_texts):
                texts = [t or "" for t in all_texts[begin:stop]]
                if subject is None:
                    touched = [k for k, t in enumerate(texts) if t and is_touched(t)]
                    changed = dict(zip(touched, (n for n, _ in normalized_batch([texts[k] for k in touched])), strict=True)) if touched else {}
                    these = [changed.get(k, t) for k, t in enumerate(texts)]
                else:
                    these = [s or "" for s in subjects[begin:stop]]
                found = list(told(texts, these))
                for at in range(0, len(found), ROWS_AT_ONCE):
                    k, rule, nth, start, end = zip(*found[at : at + ROWS_AT_ONCE], strict=True)
                    kept = [b[c].take(pa.array([begin + i for i in k], pa.int64())) for c in keys]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(rule), pa.array(nth, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=[*keys, "rule_id", "nth", "start_at", "end_at"])

    schema = passages.select(*keys).schema.add("rule_id", "string").add("nth", "long").add("start_at", "long").add("end_at", "long")
    out = rows.mapInArrow(spans, schema).withColumn("fault", F.lit(None).cast("string"))
    faults = passages.sparkSession.createDataFrame(bad, "rule_id string, fault string")
    nothing = [F.lit(None).cast(passages.schema[c].dataType).alias(c) for c in keys]
    return out.unionByName(faults.select(*nothing, "rule_id", *[F.lit(None).cast("long").alias(c) for c in ("nth", "start_at", "end_at")], "fault"))


def comparable(ids: DataFrame, excluded: DataFrame, unlisted: DataFrame, known: DataFrame) -> DataFrame:
    """Of ids (rule_id, their_id) those that both engines can be asked about: their_id is neither excluded nor unlisted, rule_id is known."""
    kept = ids.join(excluded.select("their_id"), "their_id", "left_anti").join(unlisted.select("their_id"), "their_id", "left_anti")
    return kept.join(known.select("rule_id"), "rule_id", "left_semi").select("rule_id", "their_id")


def from_bytes(spans: DataFrame, passages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Spans of bytes as spans of code points. One that begins or ends inside a character is an error: then the texts differ."""
    both = spans.join(passages.select(*keys, F.col(text).cast("binary").alias("the bytes")), keys)

    def point(column: str):
        after = F.hex(F.substring("the bytes", F.col(column).cast("int") + 1, F.lit(1)))
        inside = (after >= "80") & (after < "C0") | (F.col(column) > F.octet_length("the bytes")) | (F.col(column) < 0)
        count = F.length(F.substring("the bytes", F.lit(1), F.col(column).cast("int")).cast("string")).cast("long")
        return F.when(inside, F.raise_error(F.lit("a span is not on a character's boundary"))).otherwise(count).alias(column)

    return both.select(*(point(c) if c in ("start_at", "end_at") else F.col(c) for c in spans.columns))


def driven(ours: DataFrame, theirs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per rule how many spans both have, only ours, only theirs, in those passages in which they have any of the rule: their side drives,
    so what we find where they find nothing isn't counted (`gates.differential` counts both sides alike)."""
    keys = ["rule_id", key, "start_at", "end_at"]
    side = lambda df, a, b: df.select(*keys, F.lit(a).alias("ours"), F.lit(b).alias("theirs"))
    each = side(ours, 1, 0).unionByName(side(theirs, 0, 1)).groupBy(*keys).agg(F.max("ours").alias("ours"), F.max("theirs").alias("theirs"))
    counts = [F.count_if((F.col("ours") == a) & (F.col("theirs") == b)).alias(n) for n, a, b in (("both", 1, 1), ("only_ours", 1, 0), ("only_theirs", 0, 1))]
    of = each.groupBy("rule_id", key).agg(*counts).where(F.col("both") + F.col("only_theirs") > 0)
    return of.groupBy("rule_id").agg(*(F.sum(c).alias(c) for c in ("both", "only_ours", "only_theirs")))
