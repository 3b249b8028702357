"""All registered queries and their DuckDB oracles, merged from the per-family modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.plans import eval_queries, sampling_queries, text_queries

QueryFn = Callable[[SparkSession, str], DataFrame]

_MODULES = [eval_queries, sampling_queries, text_queries]


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
