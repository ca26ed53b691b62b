"""Query catalog: one entry per SURVEY §2 operator, each a ``(spark, sf_dir) -> DataFrame``
over the driver tables, plus (where SQL can say it) the DuckDB oracle text.

Queries read whole tables; the only ``limit`` is in P3, whose feature is a first-N sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_report(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """Round reported float aggregates (report edge): sums of doubles are order-dependent, so
    the last bits differ between engines and partitionings; the SQL rounds the same columns."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# importing the sections fills the two dicts
from evalspark.plans import q_core, q_io, q_text  # noqa: E402,F401
