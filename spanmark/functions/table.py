"""Spans as a table function, for SQL: lateral rule_spans(text, pattern)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="start_at: bigint, end_at: bigint")
class RuleSpans:
    def eval(self, text: str, pattern: str):
        for m in re.compile(pattern).finditer(text or ""):
            yield m.start(), m.end()


def register(spark: SparkSession, name: str = "rule_spans") -> None:
    spark.udtf.register(name, RuleSpans)
