"""The full per-(model, task) scorecard as one lazy plan.

Per-row scores come from the task's metric (label match, entity F1, ROUGE, pass@1 ...); the
plan then aggregates once per (model, task) and derives throughput, cost, privacy and
break-even with column arithmetic and literal-map lookups (no joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.config import GPU_COST_PER_HOUR, ROI_REFERENCE_API, TOKEN_BUDGETS
from evalspark.functions.labels import match_label
from evalspark.operators.economics import (
    api_price,
    privacy_risk,
    roi_breakeven,
    slm_cost_per_1m,
    throughput,
)


def classification_scores(preds: DataFrame, labels: list[str], prediction: str = "prediction",
                          truth: str = "true_label") -> DataFrame:
    """Per-row score of the classification tasks: N1 label match == truth."""
    matched = match_label(prediction, labels)
    return preds.withColumn("pred_label", matched) \
        .withColumn("score", (F.col("pred_label") == F.col(truth)).cast("double"))


def exact_mean(value: str, unit: int, digits: int) -> Column:
    """Mean of a column rounded half up to ``digits`` decimals, the same in any order of rows: the
    values are summed as whole multiples of 1/unit, and the quotient is rounded as integers."""
    whole = F.floor(F.col(value) * F.lit(float(unit)) + F.lit(0.5)).cast("decimal(20,0)")
    total, n = F.sum(whole), F.count(value)
    step = unit // 10 ** digits
    # round(total / (n * step)) with halves up, for values of either sign
    twice = n.cast("decimal(20,0)") * F.lit(2 * step).cast("decimal(12,0)")
    top = total * F.lit(2).cast("decimal(1,0)") + n.cast("decimal(20,0)") * F.lit(step).cast("decimal(12,0)")
    return F.when(n > 0, F.floor(top / twice).cast("double") / float(10 ** digits))


def scorecard(scored: DataFrame, by=("model", "task"), score: str = "score", latency_s: str = "latency_s",
              budgets: dict = TOKEN_BUDGETS, gpu_cost_per_hour: float = GPU_COST_PER_HOUR,
              fine_tuning_cost: float = 0.0, reference_api: str = ROI_REFERENCE_API,
              deployment: str = "on_premise") -> DataFrame:
    """Accuracy (4 dp) and mean latency (ms, 2 dp) per group; throughput from the task's token
    budget and the rounded latency; self-hosted cost; privacy; break-even vs the reference API.
    Means are exact sums, so no partitioning changes a digit."""
    latency = scored.withColumn("_ms", F.col(latency_s) * 1000)
    g = latency.groupBy(*by).agg(exact_mean(score, 10 ** 9, 4).alias("accuracy"), exact_mean("_ms", 10 ** 3, 2).alias("latency_ms"),
                                 F.count(F.lit(1)).alias("n_samples"))
    g = g.select(*by, "n_samples", "accuracy", "latency_ms")
    g = g.withColumn("tokens_per_second", throughput("latency_ms", task="task", budgets=budgets))
    g = g.withColumn("cost_per_1m_tokens", slm_cost_per_1m("tokens_per_second", gpu_cost_per_hour))
    g = g.withColumn("privacy_risk", privacy_risk(F.lit(deployment)))
    return g.withColumn("roi_breakeven_tokens",
                        roi_breakeven(F.lit(float(fine_tuning_cost)), api_price(F.lit(reference_api)),
                                      F.col("cost_per_1m_tokens")))


def scorecard_levels(scored: DataFrame, by=("model", "task"), score: str = "score", latency_s: str = "latency_s") -> DataFrame:
    """The scorecard's means for every combination of the keys in ``by``: all of them, each
    subset, and ``total``; NULL stands for a key that a level sums over, and ``level`` says which
    keys it has.  One aggregate: each row is expanded once per level and summed map-side."""
    by = list(by)
    sets = [[c for i, c in enumerate(by) if not mask >> (len(by) - 1 - i) & 1] for mask in range(2 ** len(by))]
    timed = scored.select(*by, score, (F.col(latency_s) * 1000).alias("_ms"))
    g = timed.groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in by]).agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("n_samples"),
        exact_mean(score, 10 ** 9, 4).alias("accuracy"), exact_mean("_ms", 10 ** 3, 2).alias("latency_ms"))
    names = F.create_map(*[F.lit(x) for mask, keys in enumerate(sets) for x in (mask, ", ".join(keys) or "total")])
    return g.select(F.element_at(names, F.col("_level").cast("int")).alias("level"), *by, "n_samples", "accuracy", "latency_ms")


def benchmark_records(card: DataFrame, experiment: str, run_id, start_time, phase: str = "phase2_benchmark") -> DataFrame:
    """Scorecard rows as run-log records (S7): one benchmark run per (model, task)."""
    names = ["accuracy", "latency_ms", "cost_per_1m_tokens", "roi_breakeven_tokens"]
    tags = {c: F.col(c) for c in ("model", "task", "privacy_risk")} | {"phase": F.lit(phase)}
    return card.select(
        run_id.alias("run_id"), F.lit(experiment).alias("experiment"), start_time.alias("start_time"),
        F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]).alias("tags"),
        F.create_map().cast("map<string,string>").alias("params"),
        F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))]),
                     lambda k, v: v.isNotNull()).alias("metrics"))
