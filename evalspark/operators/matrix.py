"""Run log -> benchmark matrix.

Latest-run selection is a ``min_by`` over a ``(-start_time, run_id)`` struct, for run ids of any
type: a partial aggregate, so even a (model, task) key holding a third of the log is reduced
map-side before the shuffle.  (Its struct buffer makes it a sort aggregate: the map side sorts.)  A ``row_number`` form is kept for parity checks (Spark turns its
``rn = 1`` filter into a per-partition WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.config import (
    BENCHMARK_PHASES,
    GPU_COST_PER_HOUR,
    LLM_API_COSTS,
    PHASE_FINE_TUNING,
    PRIVACY_RISK,
    ROI_REFERENCE_API,
)
from evalspark.functions.text import short_model
from evalspark.operators.economics import roi_breakeven

MATRIX_COLUMNS = ["model", "task", "method", "accuracy", "latency_ms", "cost_per_1m_tokens",
                  "privacy_risk", "roi_breakeven_tokens"]


def flatten_run_log(runs: DataFrame, tags=("model", "task", "phase", "privacy_risk", "method"),
                    metrics=("accuracy", "latency_ms", "cost_per_1m_tokens", "training_hours",
                             "roi_breakeven_tokens")) -> DataFrame:
    """Map-typed run log (tags / metrics maps) -> flat columns the matrix operators use."""
    if "tags" not in runs.columns:
        return runs
    keep = [c for c in runs.columns if c not in ("tags", "params", "metrics")]
    cols = [F.col(c) for c in keep]
    # a tag already promoted to a top-level column (e.g. ``phase`` for pushdown) is read from it
    tag = {t: F.try_element_at("tags", F.lit(t)) for t in tags}
    tag |= {t: F.coalesce(tag[t], F.lit("unknown")) for t in ("model", "task") if t in tag}  # runs without these tags
    cols += [tag[t].alias(t) for t in tags if t not in keep]
    cols += [F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics if m not in keep]
    return runs.select(*cols)


def latest(df: DataFrame, keys, time_col: str = "start_time", id_col: str = "run_id",
           method: str = "min_by") -> DataFrame:
    """B2: the latest row per key (ties on time -> smallest id; no time at all comes last)."""
    keys = list(keys)
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(F.col(time_col).desc_nulls_last(), F.col(id_col).asc())
        return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    others = [c for c in df.columns if c not in keys]
    time = F.col(time_col)
    if isinstance(df.schema[time_col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)):
        time = F.unix_micros(time.cast("timestamp"))
    order = F.struct(time.isNull().alias("n"), (-time).alias("t"), F.col(id_col).alias("i"))
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def wide_to_long(runs_wide: DataFrame, prefixes: dict, experiment_cols=("experiment",),
                 accuracy_key="accuracy", latency_key: str = "avg_latency_s",
                 latest_first: bool = True) -> DataFrame:
    """B1: prefixed metrics of the latest run per experiment become one row per model.
    A prefix without accuracy yields no row; a missing latency stays NULL.

    ``accuracy_key`` is a metric name or a Column (e.g. a per-experiment lookup)."""
    src = latest(runs_wide, experiment_cols) if latest_first else runs_wide
    pre = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(m).alias("model"))
                              for p, m in prefixes.items()])).alias("p")
    key = F.lit(accuracy_key) if isinstance(accuracy_key, str) else accuracy_key
    x = src.select(*experiment_cols, "metrics", key.alias("_acc_key"), pre)
    acc = F.try_element_at("metrics", F.concat(F.col("p.prefix"), F.lit("_"), F.col("_acc_key")))
    lat = F.try_element_at("metrics", F.concat(F.col("p.prefix"), F.lit("_" + latency_key)))
    return x.select(*experiment_cols, F.col("p.model").alias("model"), acc.alias("accuracy"),
                    lat.alias("latency_s")).filter(F.col("accuracy").isNotNull())


def api_rows(long_rows: DataFrame, task_col: str = "task", prices: dict = LLM_API_COSTS,
             api_privacy: str = PRIVACY_RISK["api"]) -> DataFrame:
    """B1 -> matrix rows: method API, published blended price, API privacy, no ROI."""
    price = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.lit(float(p["blended"])))])
    return long_rows.select(
        "model", F.col(task_col).alias("task"), F.lit("API").alias("method"), "accuracy",
        F.round(F.col("latency_s") * 1000, 2).alias("latency_ms"),
        F.try_element_at(price, F.col("model")).alias("cost_per_1m_tokens"),
        F.lit(api_privacy).alias("privacy_risk"),
        F.lit(None).cast("double").alias("roi_breakeven_tokens"))


def latest_benchmark(runs: DataFrame, phases=BENCHMARK_PHASES, key=("model", "task"),
                     per_store: bool = False, method: str = "min_by") -> DataFrame:
    """Latest benchmark run per key, benchmark phases only (the phase filter is an ``IN``
    predicate Spark pushes into the Parquet scan).  ``per_store`` = dedup inside each store."""
    r = flatten_run_log(runs).filter(F.col("phase").isin(*phases))
    keys = (["store"] if per_store else []) + list(key)
    return latest(r, keys, method=method)


def training_info(runs: DataFrame, phase: str = PHASE_FINE_TUNING, method: str = "min_by") -> DataFrame:
    """Latest fine-tuning run per (short model, task): method (default ``unknown``) and
    training hours (default 0.0)."""
    r = flatten_run_log(runs).filter(F.col("phase") == phase)
    r = r.select(short_model("model").alias("model_short"), "task", "start_time", "run_id",
                 F.coalesce("method", F.lit("unknown")).alias("method"),
                 F.coalesce("training_hours", F.lit(0.0)).alias("training_hours"))
    return latest(r, ["model_short", "task"], method=method).drop("start_time", "run_id")


def enrich(bench: DataFrame, train: DataFrame, reference_api: str = ROI_REFERENCE_API,
           gpu_cost_per_hour: float = GPU_COST_PER_HOUR, prices: dict = LLM_API_COSTS) -> DataFrame:
    """With training info -> its method and ROI recomputed from training hours against the
    reference API; without -> logged method (default ``API``) and logged ROI.
    ``train`` has one row per (model, task)."""
    api_cost = float(prices[reference_api]["blended"])
    b = bench.withColumn("model_short", short_model("model"))
    if "roi_breakeven_tokens" not in b.columns:
        b = b.withColumn("roi_breakeven_tokens", F.lit(None).cast("double"))
    if "method" not in b.columns:
        b = b.withColumn("method", F.lit(None).cast("string"))
    t = train.select("model_short", "task", F.col("method").alias("t_method"),
                     F.col("training_hours").alias("t_hours"))
    b = b.drop("t_method", "t_hours")
    j = b.join(t, ["model_short", "task"], "left")
    has_train = F.col("t_method").isNotNull()
    ft_cost = F.col("t_hours") * float(gpu_cost_per_hour)
    roi_new = F.when(F.col("cost_per_1m_tokens").isNull(), F.lit(None).cast("double")) \
        .otherwise(roi_breakeven(ft_cost, F.lit(api_cost), F.col("cost_per_1m_tokens")))
    return j.select(
        F.col("model_short").alias("model"), "task",
        F.when(has_train, F.col("t_method")).otherwise(F.coalesce("method", F.lit("API"))).alias("method"),
        "accuracy", "latency_ms", "cost_per_1m_tokens",
        F.coalesce("privacy_risk", F.lit("unknown")).alias("privacy_risk"),
        F.when(has_train, roi_new).otherwise(F.col("roi_breakeven_tokens")).alias("roi_breakeven_tokens"))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Union by column name into the 8-column matrix."""
    out = frames[0].select(*MATRIX_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*MATRIX_COLUMNS))
    return out


def accuracy_pivot(matrix: DataFrame, tasks, index: str = "model") -> DataFrame:
    """Mean accuracy, model x task; explicit pivot values avoid a distinct-values job."""
    return matrix.groupBy(index).pivot("task", list(tasks)).agg(F.avg("accuracy"))


def grid(spark_df_like: DataFrame, models, tasks) -> DataFrame:
    """Declared (model, task) grid from literal lists via two generators (no join)."""
    return spark_df_like.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model")) \
        .select("model", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))


def missing_cells(matrix: DataFrame, models, tasks) -> DataFrame:
    """Declared (model, task) cells with no row in ``matrix`` (left anti join)."""
    g = grid(matrix, models, tasks)
    have = matrix.select("model", "task").distinct()
    return g.join(have, ["model", "task"], "left_anti")


def short_name(df: DataFrame, col: str = "model") -> DataFrame:
    """N8 as an operator."""
    return df.withColumn(f"{col}_short", short_model(col))


def compile_matrix(runs: DataFrame, runs_wide: DataFrame | None, prefixes: dict,
                   experiment_cols=("experiment",), accuracy_key="accuracy", task_col: str = "task",
                   per_store: bool = False, reference_api: str = ROI_REFERENCE_API,
                   method: str = "min_by") -> DataFrame:
    """Wide API runs (B1) + latest benchmark runs (B3) enriched with training info (B4, B5),
    unioned (B6) into the 8-column matrix, as one lazy plan."""
    bench = latest_benchmark(runs, per_store=per_store, method=method)
    train = training_info(runs, method=method)
    slm = enrich(bench, train, reference_api=reference_api)
    if runs_wide is None:
        return slm.select(*MATRIX_COLUMNS)
    api = api_rows(wide_to_long(runs_wide, prefixes, experiment_cols, accuracy_key), task_col=task_col)
    return union_rows(api, slm)


def registry_rows(runs_wide: DataFrame, table: dict, prefixes: dict, experiment: str = "experiment",
                  latency_key: str = "avg_latency_s") -> DataFrame:
    """B1 by registry: wide runs of the registered experiments only (``table``: experiment ->
    (task, accuracy metric)), each scored by its own accuracy metric; matrix rows of the APIs."""
    task = F.create_map(*[x for e, (t, _) in table.items() for x in (F.lit(e), F.lit(t))])
    metric = F.create_map(*[x for e, (_, m) in table.items() for x in (F.lit(e), F.lit(m))])
    known = runs_wide.filter(F.col(experiment).isin(*table))
    rows = wide_to_long(known, prefixes, (experiment,), accuracy_key=F.try_element_at(metric, F.col(experiment)),
                        latency_key=latency_key)
    return api_rows(rows.withColumn("task", F.try_element_at(task, F.col(experiment))))
