"""Annotation of a stream of passages (an extension): matching is a map of each passage, so only what is counted or
told apart over time needs state, which the watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmark.operators.spans import analyzed


def annotate_stream(passages: DataFrame, rules: list[tuple[str, str]], keys: list[str], at: str, late: str = "10 minutes", text: str = "text") -> DataFrame:
    """Spans of a stream of passages with their time `at`; a passage that comes again within `late` is read once."""
    once = passages.withColumn("digest of the text", F.sha2(text, 256)).withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, "digest of the text"])
    return analyzed(once, rules, [*keys, at], text)


def incidence_stream(spans: DataFrame, at: str, window: str = "5 minutes") -> DataFrame:
    """How often each rule matches in each window of time."""
    return spans.groupBy(F.window(at, window).alias("span_of_time"), "rule_id").agg(F.count(F.lit(1)).alias("occurrences"))
