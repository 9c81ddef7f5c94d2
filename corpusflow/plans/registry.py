"""Query registry: operator id -> (Spark builder, DuckDB oracle SQL).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the
whole driver tables.  Computed columns carry the same alias in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(qid: str, sql: str | None = None):
    """Register a builder under ``qid``; ``sql`` is its DuckDB twin (omit
    it for operators that SQL cannot express)."""
    def deco(fn: Builder) -> Builder:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLE[qid] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from . import corpus, text, aggregates, timeseries, links, models, sources, streams  # noqa: F401
