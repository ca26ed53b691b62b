"""Row-level and aggregate metrics.

All group metrics are algebraic aggregates (count / sum / avg / stddev / max_by), so Spark's
partial (map-side) aggregation absorbs a hot (model, task) group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.config import LATENCY_OUTLIER_S, PASS_AT_K
from evalspark.functions.labels import is_error


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- M1 / M2 / I5 -----------------------------------------------------------------------

def accuracy(df: DataFrame, correct: str = "correct", by=("model", "task"),
             errors: str = "wrong", prediction: str = "prediction") -> DataFrame:
    """M1: mean of a 0/1 ``correct`` column per group.  I5: ``errors='wrong'`` keeps sentinel
    outputs as wrong answers (reference rule); ``'exclude'`` drops them from the denominator."""
    c = _c(correct).cast("double")
    if errors == "exclude":
        c = F.when(is_error(prediction), F.lit(None).cast("double")).otherwise(c)
    return df.groupBy(*by).agg(F.avg(c).alias("accuracy"))


def mean_latency_ms(df: DataFrame, latency_s: str = "latency_s", by=("model", "task")) -> DataFrame:
    """M2: mean latency in milliseconds (unrounded; round at the report edge)."""
    return df.groupBy(*by).agg((F.avg(latency_s) * 1000).alias("latency_ms"))


# --- M4 / M5: set overlap scores ----------------------------------------------------------

def token_f1_scores(df: DataFrame, truth_set, pred_set, keep=(), drop_empty: bool = True) -> DataFrame:
    """M4 as staged projections: sets, then counts, then ratios.  Each stage is a separate
    projection whose columns are referenced several times, so Catalyst keeps it instead of
    re-deriving the token sets inside every ratio.  Rows with an empty truth are dropped, or
    with ``drop_empty=False`` kept with NULL scores (which means skip)."""
    keep = list(keep)
    x = df.select(*keep, _c(truth_set).alias("_t"), _c(pred_set).alias("_p"))
    x = x.select(*keep, F.size("_t").alias("_nt"), F.size("_p").alias("_np"),
                 F.size(F.array_intersect("_t", "_p")).cast("double").alias("_tp"))
    if drop_empty:
        x = x.filter(F.col("_nt") > 0)
    some = F.col("_nt") > 0
    precision = F.when(F.col("_np") > 0, F.col("_tp") / F.col("_np")).otherwise(F.lit(0.0))
    x = x.select(*keep, F.when(some, precision).alias("precision"), F.when(some, F.col("_tp") / F.col("_nt")).alias("recall"))
    f1 = F.when(F.col("recall").isNotNull(), _f1("precision", "recall"))
    return x.select(*keep, "precision", "recall", f1.alias("f1"))


def _f1(p, r) -> Column:
    p, r = _c(p), _c(r)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def entity_prf_scores(df: DataFrame, truth_set, pred_set, keep=()) -> DataFrame:
    """M5 as staged projections (see ``token_f1_scores``)."""
    keep = list(keep)
    x = df.select(*keep, _c(truth_set).alias("_t"), _c(pred_set).alias("_p"))
    x = x.select(*keep, F.size("_t").alias("_nt"), F.size("_p").alias("_np"),
                 F.size(F.array_intersect("_t", "_p")).cast("double").alias("_tp"))
    both_empty = (F.col("_nt") == 0) & (F.col("_np") == 0)
    prec = F.when(both_empty, F.lit(1.0)).when(F.col("_np") > 0, F.col("_tp") / F.col("_np")).otherwise(F.lit(0.0))
    rec = F.when(both_empty, F.lit(1.0)).when(F.col("_nt") > 0, F.col("_tp") / F.col("_nt")).otherwise(F.lit(0.0))
    x = x.select(*keep, prec.alias("precision"), rec.alias("recall"))
    return x.select(*keep, "precision", "recall", _f1("precision", "recall").alias("f1"))


def entity_correct(f1, threshold: float = 0.5) -> Column:
    """1 when entity F1 >= threshold."""
    return (_c(f1) >= F.lit(threshold)).cast("int")


# --- M6 / M7: pass@k ---------------------------------------------------------------------

def pass_at_k_expr(n, c, k) -> Column:
    """Unbiased pass@k = 1 - prod_{i<k} (n-c-i)/(n-i); 1.0 when n-c < k; NULL when n < k."""
    n, c, k = _c(n).cast("double"), _c(c).cast("double"), _c(k)
    prod = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(1.0),
                       lambda acc, i: acc * (n - c - i) / (n - i))
    return (F.when(n < k, F.lit(None).cast("double"))
            .when(n - c < k, F.lit(1.0))
            .otherwise(1.0 - prod))


def pass_at_k(df: DataFrame, ks=PASS_AT_K, by=("model",), problem: str = "problem_id",
              passed: str = "passed", per_problem: bool = False) -> DataFrame:
    """M6: per (group, problem) n and c (partial aggregation), then pass@k for every k, then the
    mean over problems.  The k list is a literal array exploded per row (no join)."""
    g = df.groupBy(*by, problem).agg(F.count(F.lit(1)).alias("n"), F.sum(passed).alias("c"))
    g = g.select("*", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    g = g.withColumn("pass_at_k", pass_at_k_expr("n", "c", "k"))
    if per_problem:
        return g
    return g.groupBy(*by, "k").agg(F.avg("pass_at_k").alias("pass_at_k"),
                                   F.count("pass_at_k").alias("n_problems"))


def greedy_pass(df: DataFrame, by=("model",), passed: str = "passed",
                config_col: str = "config", greedy: str = "greedy") -> DataFrame:
    """M7: pass@1 (mean) and pass count of greedy generations."""
    return df.filter(F.col(config_col) == greedy).groupBy(*by).agg(
        F.avg(F.col(passed).cast("double")).alias("pass_at_1"),
        F.sum(passed).cast("bigint").alias("n_passed"),
        F.count(F.lit(1)).alias("n"))


def problem_scores(df: DataFrame, by=("model",), problem: str = "problem_id", passed: str = "passed",
                   latency_s: str = "latency_s") -> DataFrame:
    """Per (group, problem): pass@1 over its solutions (c / n) and the mean latency of one solution.
    Latencies are summed as whole microseconds, so no order of rows changes a digit."""
    micros = F.floor(F.col(latency_s) * F.lit(1e6) + F.lit(0.5)).cast("decimal(20,0)")
    g = df.groupBy(*by, problem).agg(F.count(F.lit(1)).alias("n"), F.sum(passed).alias("c"),
                                     F.sum(micros).cast("double").alias("_us"), F.count(latency_s).alias("_timed"))
    return g.select(*by, problem, (F.col("c").cast("double") / F.col("n")).alias("score"),
                    (F.try_divide(F.col("_us"), F.col("_timed")) / F.lit(1e6)).alias("latency_s"))


# --- M8 / M9 / M10 -------------------------------------------------------------------------

def latency_profile(df: DataFrame, latency: str = "latency_s", sample: str = "sample_id",
                    by=("model",)) -> DataFrame:
    """M8: mean, sample std, max (+ the first sample holding it), min.  ``min_by`` over
    ``struct(-latency, sample)`` keeps the first maximum, as ``idxmax`` does, for ids of any type."""
    key = F.when(F.col(latency).isNotNull(), F.struct((-F.col(latency)).alias("l"), F.col(sample).alias("s")))
    return df.groupBy(*by).agg(
        F.avg(latency).alias("mean_latency"),
        F.stddev_samp(latency).alias("std_latency"),
        F.max(latency).alias("max_latency"),
        F.min_by(sample, key).alias("max_latency_sample"),
        F.min(latency).alias("min_latency"),
        F.count(F.lit(1)).alias("n"))


def latency_outliers(df: DataFrame, latency: str = "latency_s",
                     threshold: float = LATENCY_OUTLIER_S) -> DataFrame:
    """M9: rows slower than the threshold (a filter Spark pushes into the scan)."""
    return df.filter(F.col(latency) > F.lit(float(threshold)))


def output_length(df: DataFrame, text: str = "code", by=("model",), chars_per_token: int = 4) -> DataFrame:
    """Mean output length in characters and estimated tokens (chars / 4)."""
    n = F.length(text).cast("double")
    return df.groupBy(*by).agg(F.avg(n).alias("mean_chars"),
                               F.avg(n / chars_per_token).alias("mean_est_tokens"))


# --- M18 -----------------------------------------------------------------------------------

def compare_configs(df: DataFrame, configs=("sampled", "greedy"), key=("model", "problem_id"),
                    config_col: str = "config", passed: str = "passed") -> DataFrame:
    """Per problem, pass rate under each decoding configuration and their difference.
    Pivot values are explicit, so no extra job discovers them."""
    a, b = configs
    p = df.groupBy(*key).pivot(config_col, list(configs)).agg(F.avg(F.col(passed).cast("double")))
    return p.select(*key, F.col(a).alias(f"{a}_pass"), F.col(b).alias(f"{b}_pass"),
                    (F.col(a) - F.col(b)).alias("delta"))
