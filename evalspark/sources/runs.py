"""Run store (S4-S7): experiment runs as a Parquet table partitioned by experiment.

Schema: ``run_id, start_time, phase`` (top-level, so phase predicates reach the Parquet
reader), ``tags / params / metrics`` maps, partition column ``experiment``.  Several stores
are several paths read together, with a ``store`` column."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def run_records(df: DataFrame, experiment, run_id: str, start_time: str, tags: dict, metrics: dict,
                params: dict | None = None) -> DataFrame:
    """Build one record per run from columns: ``tags`` / ``metrics`` / ``params`` map names to
    columns (or Columns)."""
    def m(d, cast):
        if not d:
            return F.create_map().cast(f"map<string,{cast}>")
        return F.create_map(*[x for k, v in d.items()
                              for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast(cast))])
    exp = F.col(experiment) if isinstance(experiment, str) else experiment
    t = m(tags, "string")
    return df.select(F.col(run_id).alias("run_id"), F.col(start_time).alias("start_time"),
                     F.try_element_at(t, F.lit("phase")).alias("phase"), t.alias("tags"),
                     m(params or {}, "string").alias("params"), m(metrics, "double").alias("metrics"),
                     exp.alias("experiment"))


def append_runs(records: DataFrame, path: str) -> None:
    """Append run records (one write for any number of runs)."""
    records.write.mode("append").partitionBy("experiment").parquet(path)


def read_runs(spark: SparkSession, *paths: str, store_names=None) -> DataFrame:
    """Read one or several stores; ``store`` names which path a run came from.
    Filters on ``experiment`` prune partitions, filters on ``phase`` are pushed down."""
    frames = []
    for i, p in enumerate(paths):
        name = store_names[i] if store_names else str(i)
        frames.append(spark.read.parquet(p).withColumn("store", F.lit(name)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


_ORDER = re.compile(r"^(?:(metrics|params|tags)\.(.+?)|(\w+))(?:\s+(asc|desc))?$", re.I)


def _ordering(order_by: Iterable[str]) -> list[Column]:
    """``metrics.accuracy DESC``, ``tags.model`` or a top-level column; runs without a value come
    last, equal ones by their id."""
    out = []
    for text in order_by:
        m = _ORDER.match(text.strip())
        if not m:
            raise ValueError(f"cannot order by {text!r}")
        column = F.try_element_at(F.col(m[1].lower()), F.lit(m[2].strip("`"))) if m[1] else F.col(m[3])
        out.append(column.desc_nulls_last() if (m[4] or "").lower() == "desc" else column.asc_nulls_last())
    return [*out, F.col("run_id").asc_nulls_last()]


def search_runs(spark: SparkSession, *paths: str, experiments: Iterable[str] | None = None, phase: str | None = None,
                since=None, until=None, tags: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None,
                order_by: Iterable[str] = ("start_time DESC",), max_results: int | None = None, per_experiment: bool = False,
                store_names=None) -> DataFrame:
    """The first ``max_results`` runs in an order, of all experiments together or of each.

    Experiments prune partitions (files of others are never listed or opened); ``phase`` and the
    time range ``[since, until)`` reach the Parquet reader, which skips row groups by their
    statistics; ``tags`` and ``params`` are exact matches on what is left.  A limit over all runs
    is a top-n in every task (no full sort); one per experiment is a window whose rank limit
    Spark applies in every task before rows are shuffled, so an experiment that holds a third of
    all runs sends ``max_results`` rows a task."""
    runs = read_runs(spark, *paths, store_names=store_names)
    if experiments is not None:
        runs = runs.filter(F.col("experiment").isin(list(experiments)))
    if phase is not None:
        runs = runs.filter(F.col("phase") == phase)
    if since is not None:
        runs = runs.filter(F.col("start_time") >= F.lit(since))
    if until is not None:
        runs = runs.filter(F.col("start_time") < F.lit(until))
    for column, wanted in (("tags", tags), ("params", params)):
        for key, value in (wanted or {}).items():
            runs = runs.filter(F.try_element_at(F.col(column), F.lit(key)) == value)
    order = _ordering(order_by)
    if max_results is None:
        return runs
    if not per_experiment:
        return runs.orderBy(*order).limit(max_results)
    place = F.row_number().over(Window.partitionBy("experiment").orderBy(*order))
    return runs.withColumn("_place", place).filter(F.col("_place") <= max_results).drop("_place")


def union_stores(*frames: DataFrame) -> DataFrame:
    """S5 for frames already loaded (schema generations may differ: missing columns -> NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
