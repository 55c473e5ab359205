"""All registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsentry.plans import case_queries, score_queries, stream_queries, text_queries
from docsentry.sources.bindings import Inputs
from docsentry.sources.bindings import check_sql as expand

_PARTS = [text_queries, case_queries, score_queries, stream_queries]


def _runner(fn: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Inputs(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(fn) for part in _PARTS for name, fn in part.QUERIES.items()}


def check_sql() -> dict[str, str]:
    extra = {name: sql for part in _PARTS for name, sql in part.EXTRA_VIEWS.items()}
    return {name: expand(sql, extra) for part in _PARTS for name, sql in part.CHECKS.items()}
