"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return q.QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return dict(q.ORACLES)
