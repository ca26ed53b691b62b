"""Wide prediction logs (one row per sample, one column group per provider) -> long
``predictions`` rows, across log schema generations.

Generations seen in practice: ``{p}_pred`` + ``{p}_latency`` (older) and ``{p}_pred`` +
``{p}_correct`` + ``{p}_latency_s`` (newer).  The reader picks per provider whichever columns exist, and unpivots with one ``explode`` of a
literal array of structs - a narrow operation, no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.sources.csv_blocks import read_csv_blocks

PRED_SUFFIXES = ("_pred", "_response", "_summary", "_code")
LATENCY_SUFFIXES = ("_latency_s", "_latency")


def read_wide_log(spark: SparkSession, path: str) -> DataFrame:
    """S1 for logs: header CSV read as strings (schemas differ by generation; typed later).

    Tasks read every file's header, and parse each file by the header it has, in blocks: values
    with line ends inside do not keep a file in one task.  NULL where a generation lacks a
    column."""
    return read_csv_blocks(spark, path)


def write_wide_log(log: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV that keeps leading/trailing blanks (Spark's writer trims them by default)."""
    (log.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _present(cols, prefix, suffixes):
    """The provider's column under whichever names the generations gave it."""
    found = [F.col(prefix + s) for s in suffixes if prefix + s in cols]
    return F.coalesce(*found) if found else None


def wide_to_long_predictions(log: DataFrame, providers: dict, id_cols=("sample_id",),
                             keep=("true_label",)) -> DataFrame:
    """``providers`` maps column prefix -> model name.  Output: ``id_cols, keep, model,
    prediction, latency_s, correct`` (NULL where a generation lacks the column).  A provider
    without a prediction column is skipped (an interrupted run)."""
    cols = set(log.columns)
    parts = []
    for prefix, model in providers.items():
        pred = _present(cols, prefix, PRED_SUFFIXES)
        if pred is None:
            continue
        lat = _present(cols, prefix, LATENCY_SUFFIXES)
        cor = prefix + "_correct" if prefix + "_correct" in cols else None
        parts.append(F.struct(
            F.lit(model).alias("model"),
            pred.cast("string").alias("prediction"),
            (lat.cast("double") if lat is not None else F.lit(None).cast("double")).alias("latency_s"),
            (F.col(cor).cast("int") if cor else F.lit(None).cast("int")).alias("correct")))
    if not parts:
        raise ValueError(f"no provider columns found for {sorted(providers)}")
    keep = [c for c in keep if c in cols]
    return log.select(*id_cols, *keep, F.explode(F.array(*parts)).alias("_r")).select(*id_cols, *keep, "_r.*")


def long_to_wide_log(preds: DataFrame, models: list, id_cols=("sample_id", "true_label"),
                     generation: dict | None = None) -> DataFrame:
    """The inverse, for producing logs: pivot with explicit model values (one aggregation,
    one row per sample).  ``generation`` maps model -> 'old' | 'new' column naming."""
    generation = generation or {}
    g = preds.groupBy(*id_cols).pivot("model", list(models)).agg(
        F.max("prediction").alias("pred"), F.max("latency_s").alias("lat"))
    out = [F.col(c) for c in id_cols]
    for m in models:
        old = generation.get(m) == "old"
        out.append(F.col(f"{m}_pred").alias(f"{m}_pred"))
        out.append(F.col(f"{m}_lat").alias(f"{m}_latency" if old else f"{m}_latency_s"))
    return g.select(*out)
