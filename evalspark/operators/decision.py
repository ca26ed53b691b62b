"""Constraint-filtered recommendation and cost projections.

All scenarios are decided at once: scenarios equi-join the benchmark matrix on ``task``
(one row per (model, task)); no join carries a hint, AQE picks the strategy by bytes.  D1, D2,
D4, D5 and D8 look the answer up in per-task staircases instead (``asof``): scenarios keep their
columns through one join on the task, are never grouped or joined back, and no scenario x
model rows exist, so scenario tables of any size (e.g. what-if sweeps) scale linearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.config import ROI_REFERENCE_API

INF = float("inf")
NONE_LABEL = "NONE (no model meets constraints)"
MATRIX_COLS = ["model", "task", "method", "accuracy", "latency_ms", "cost_per_1m_tokens",
               "privacy_risk", "roi_breakeven_tokens"]


def _clean_matrix(matrix: DataFrame) -> DataFrame:
    """NaN -> NULL at ingest (pandas skips NaN; Spark would treat it as the largest value)."""
    out = matrix
    for c in ("accuracy", "cost_per_1m_tokens", "latency_ms"):
        if c in matrix.columns:
            out = out.withColumn(c, F.when(F.isnan(c), None).otherwise(F.col(c)))
    return out


def projected_cost(cost_per_1m, volume) -> Column:
    """D3: projected monthly cost = cost per 1M tokens / 1e6 x monthly volume."""
    c = F.col(cost_per_1m) if isinstance(cost_per_1m, str) else cost_per_1m
    v = F.col(volume) if isinstance(volume, str) else volume
    return c / 1e6 * v


def candidates(matrix: DataFrame, scenarios: DataFrame, low_level: str = "low") -> DataFrame:
    """Matrix rows of each scenario's task, privacy-filtered when the scenario requires it."""
    m = _clean_matrix(matrix).select(*[c for c in MATRIX_COLS if c in matrix.columns])
    j = scenarios.join(m, "task")
    return j.filter(~F.col("privacy_required") | (F.col("privacy_risk") == low_level))


def eligible(matrix: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Candidates meeting the accuracy threshold (NULL accuracy is never eligible)."""
    return candidates(matrix, scenarios) \
        .filter(F.col("accuracy") >= F.col("min_accuracy")) \
        .withColumn("projected_monthly_cost", projected_cost("cost_per_1m_tokens", "monthly_volume"))


def recommend(matrix: DataFrame, scenarios: DataFrame) -> DataFrame:
    """D1 + D4: per scenario the eligible model with the lowest projected cost (ties: model name;
    NULL cost last) and the number of eligible candidates.  Unsatisfiable scenarios get no row."""
    e = eligible(matrix, scenarios)
    key = F.struct(F.coalesce(F.col("projected_monthly_cost"), F.lit(INF)).alias("k0"),
                   F.col("projected_monthly_cost").isNull().alias("k1"), F.col("model").alias("k2"))
    best = F.min_by(F.struct("model", "method", "accuracy", "cost_per_1m_tokens", "privacy_risk",
                             "roi_breakeven_tokens", "projected_monthly_cost"), key)
    g = e.groupBy("scenario").agg(best.alias("r"), F.count(F.lit(1)).alias("n_eligible_candidates"))
    return g.select("scenario", "r.*", "n_eligible_candidates")


_BEST_FIELDS = ["model", "method", "accuracy", "cost_per_1m_tokens", "privacy_risk", "roi_breakeven_tokens"]


def staircase(matrix: DataFrame, low_level: str = "low") -> DataFrame:
    """Per (task, privacy_required): the candidates sorted by accuracy (descending) folded into
    one short array of steps ``struct(accuracy, n, pos, neg, zero, null)``.  ``n`` counts all
    candidates at least this accurate; the other fields are the best of them under the
    projected-cost order for a positive, negative, zero and NULL monthly volume (price x volume
    ascending, NULL last, ties by model).  Built from the small matrix only: a running window
    over each task's models, then one row per (task, privacy class)."""
    m = _clean_matrix(matrix).select(*[c for c in MATRIX_COLS if c in matrix.columns]) \
        .filter(F.col("accuracy").isNotNull())
    m = m.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("privacy_required")) \
        .filter(~F.col("privacy_required") | (F.col("privacy_risk") == low_level))
    cost, row = F.col("cost_per_1m_tokens"), F.struct(*_BEST_FIELDS)
    no_cost = cost.isNull()
    keys = {  # sort keys equivalent to (projected cost asc nulls last, model) for each volume sign
        "pos": F.struct(F.coalesce(cost, F.lit(INF)).alias("a"), no_cost.alias("b"), F.col("model").alias("c"), row.alias("r")),
        "neg": F.struct(F.coalesce(-cost, F.lit(INF)).alias("a"), no_cost.alias("b"), F.col("model").alias("c"), row.alias("r")),
        "zero": F.struct(no_cost.alias("b"), F.col("model").alias("c"), row.alias("r")),
        "null": F.struct(F.col("model").alias("c"), row.alias("r")),
    }
    w = Window.partitionBy("task", "privacy_required").orderBy(F.col("accuracy").desc(), F.col("model")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = m.select("task", "privacy_required", "accuracy", F.count(F.lit(1)).over(w).alias("n"),
                   *[F.min(k).over(w)["r"].alias(name) for name, k in keys.items()])
    # equal accuracies are one step: keep the last row of each (it has seen all of them)
    step = run.groupBy("task", "privacy_required", "accuracy").agg(
        F.max_by(F.struct("pos", "neg", "zero", "null"), "n").alias("b"), F.max("n").alias("n"))
    return step.groupBy("task", "privacy_required").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("accuracy")).alias("neg_accuracy"), "accuracy", "n", "b.pos", "b.neg", "b.zero", "b.null")
    )).alias("steps"))


def asof(matrix: DataFrame, scenarios: DataFrame, low_level: str = "low") -> DataFrame:
    """Every scenario (all its columns) with its recommendation, NULL if unsatisfiable, and its
    number of eligible candidates: a left join with the staircase of its (task, privacy class),
    the last step whose accuracy still meets the threshold, and that step's best model for the
    sign of the volume."""
    j = scenarios.join(staircase(matrix, low_level), ["task", "privacy_required"], "left")
    hit = F.try_element_at(F.filter("steps", lambda x: x["accuracy"] >= F.col("min_accuracy")), F.lit(-1))
    x = j.select(*scenarios.columns, hit.alias("_h"))
    v = F.col("monthly_volume")
    best = (F.when(v > 0, F.col("_h.pos")).when(v < 0, F.col("_h.neg")).when(v == 0, F.col("_h.zero"))
            .otherwise(F.col("_h.null")))
    x = x.select(*scenarios.columns, best.alias("_b"), F.coalesce("_h.n", F.lit(0).cast("bigint")).alias("n_eligible_candidates"))
    return x.select(*scenarios.columns, *[F.col(f"_b.{c}").alias(c) for c in _BEST_FIELDS],
                    projected_cost(F.col("_b.cost_per_1m_tokens"), v).alias("projected_monthly_cost"),
                    "n_eligible_candidates")


def recommend_asof(matrix: DataFrame, scenarios: DataFrame, low_level: str = "low") -> DataFrame:
    """D1 + D4 as an as-of lookup; the same output as ``recommend``."""
    return asof(matrix, scenarios, low_level).filter("n_eligible_candidates > 0").select(
        "scenario", *_BEST_FIELDS, "projected_monthly_cost", "n_eligible_candidates")


def fallback(matrix: DataFrame, scenarios: DataFrame, top: int = 3) -> DataFrame:
    """For scenarios nobody satisfies, the ``top`` best candidates by accuracy (NULL last,
    ties by model).  Window partitions hold one scenario's candidates (<= #models rows)."""
    unmet = asof(matrix, scenarios).filter("n_eligible_candidates = 0").select(*scenarios.columns)
    c = candidates(matrix, unmet)
    w = Window.partitionBy("scenario").orderBy(F.col("accuracy").desc_nulls_last(), F.col("model"))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top) \
        .select("scenario", "rank", "model", "method", "accuracy", "cost_per_1m_tokens", "privacy_risk")


def validation_report(matrix: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row per scenario; unsatisfiable -> ``NONE ...`` / ``-`` / NULL / 0."""
    return asof(matrix, scenarios).select(
        "scenario", "task", "monthly_volume", "min_accuracy", "privacy_required",
        F.coalesce("model", F.lit(NONE_LABEL)).alias("recommended_model"),
        F.coalesce("method", F.lit("-")).alias("recommended_method"),
        F.round("accuracy", 4).alias("accuracy"),
        F.round("projected_monthly_cost", 2).alias("projected_monthly_cost_usd"),
        F.col("n_eligible_candidates").cast("int").alias("n_eligible_candidates"))


def reference_api_cost(matrix: DataFrame, reference: str = ROI_REFERENCE_API) -> Column:
    """The reference API's price per 1M tokens as stored in the matrix, as a scalar
    subquery column (Spark plans it once; no cross join)."""
    return matrix.filter(F.col("model") == reference).select(F.min("cost_per_1m_tokens")).scalar()


def implied_fine_tuning_cost(matrix: DataFrame, reference: str = ROI_REFERENCE_API,
                             low_level: str = "low") -> DataFrame:
    """Recover the fine-tuning cost baked into a finite break-even; 0 otherwise."""
    ref = reference_api_cost(matrix, reference)
    roi = F.col("roi_breakeven_tokens")
    zero = roi.isNull() | F.isnan(roi) | (roi == F.lit(INF)) | (F.col("privacy_risk") != low_level)
    return matrix.withColumn("reference_api_cost", ref).withColumn(
        "implied_fine_tuning_cost",
        F.when(zero, F.lit(0.0)).otherwise((F.col("reference_api_cost") - F.col("cost_per_1m_tokens")) / 1e6 * roi))


def cost_curves(matrix: DataFrame, scenarios: DataFrame, reference: str = ROI_REFERENCE_API,
                min_span: int = 20_000_000, points: int = 100, low_level: str = "low") -> DataFrame:
    """Cumulative cost curves for scenarios whose recommendation is self-hosted: volumes
    0 .. x_max-1 in steps of max(x_max div points, 1), x_max = max(min_span, int(1.2 x volume));
    SLM = implied fine-tuning cost + variable cost, API = reference price x volume."""
    rec = asof(matrix, scenarios).filter(F.col("privacy_risk") == low_level)
    ft = implied_fine_tuning_cost(matrix, reference).select("model", "task", "implied_fine_tuning_cost",
                                                            "reference_api_cost")
    j = rec.join(ft, ["model", "task"], "left")
    x_max = F.greatest(F.lit(min_span).cast("bigint"), (F.col("monthly_volume") * 1.2).cast("bigint"))
    step = F.greatest(F.floor(x_max / points).cast("bigint"), F.lit(1).cast("bigint"))
    pts = j.select("scenario", "model", "cost_per_1m_tokens", "implied_fine_tuning_cost", "reference_api_cost",
                   F.explode(F.sequence(F.lit(0).cast("bigint"), x_max - 1, step)).alias("volume"))
    return pts.select(
        "scenario", "model", "volume",
        (F.coalesce("implied_fine_tuning_cost", F.lit(0.0)) + projected_cost("cost_per_1m_tokens", "volume"))
        .alias("slm_cost"),
        projected_cost("reference_api_cost", "volume").alias("api_cost"))


def ranked_candidates(matrix: DataFrame, privacy_low_only: bool = False, low_level: str = "low") -> DataFrame:
    """Every task's candidates ranked by accuracy (NULL last, ties by model)."""
    m = _clean_matrix(matrix)
    if privacy_low_only:
        m = m.filter(F.col("privacy_risk") == low_level)
    w = Window.partitionBy("task").orderBy(F.col("accuracy").desc_nulls_last(), F.col("model"))
    return m.select("task", "model", "method", "accuracy", "cost_per_1m_tokens", "latency_ms", "privacy_risk") \
        .withColumn("rank", F.row_number().over(w))


def cost_chart(matrix: DataFrame, scenarios: DataFrame, low_level: str = "low") -> DataFrame:
    """Per scenario, each candidate's projected monthly cost (ascending rank) and its
    privacy class (on-premise vs API)."""
    c = candidates(matrix, scenarios).withColumn(
        "projected_monthly_cost", projected_cost("cost_per_1m_tokens", "monthly_volume"))
    w = Window.partitionBy("scenario").orderBy(F.col("projected_monthly_cost").asc_nulls_last(), F.col("model"))
    return c.select("scenario", "model", "projected_monthly_cost",
                    F.when(F.col("privacy_risk") == low_level, "on_premise").otherwise("api").alias("deployment"),
                    F.row_number().over(w).alias("rank"))


def breakeven_verdict(matrix: DataFrame) -> DataFrame:
    """Finite break-even -> ``at_volume`` (with the volume), NULL/inf -> ``never``."""
    roi = F.col("roi_breakeven_tokens")
    never = roi.isNull() | F.isnan(roi) | (roi == F.lit(INF))
    return matrix.select("model", "task",
                         F.when(never, "never").otherwise("at_volume").alias("verdict"),
                         F.when(never, None).otherwise(roi).alias("breakeven_tokens"))
