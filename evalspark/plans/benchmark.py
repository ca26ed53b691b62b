"""B8 over the fixture run log, shared by the matrix, statistics and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark import fixtures as fx
from evalspark.operators.matrix import compile_matrix


def fixture_matrix(spark: SparkSession, sf: str, per_store: bool = False) -> DataFrame:
    """The benchmark matrix compiled from the ``runs`` view: the latest wide run per task
    stands for the API baselines (prefix ``a`` -> gpt-4o, ``b`` -> gemini-2.5-flash)."""
    runs = fx.runs(spark, sf)
    wide = fx.runs_wide(spark, sf, experiment_cols=("task",))
    return compile_matrix(runs, wide, fx.API_PREFIXES, experiment_cols=("task",),
                       accuracy_key=fx.API_TASK_METRIC, per_store=per_store)
