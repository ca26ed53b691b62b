"""Paired significance tests.

The paired differences of all candidates and baselines are summed in blocks: a task takes the
units of its partition, a few thousand at a time, as matrices (units x candidates and units x
baselines) and keeps count, mean and squared deviations of every pair.  What leaves a task is one
row per pair, whatever the number of its units; nothing of the size of pairs x units exists.
T2 evaluates the Student-t tail on the *aggregated* rows only (one row per pair)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Units that a task turns into matrices at a time.
BLOCK_UNITS = 2048


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def _log_cos(angle):
    return 0.5 * np.log1p(-np.sin(angle) ** 2)


def _tail(power: float, low: float) -> float:
    """The integral of (cos x / cos low) ** power from ``low`` to a right angle, by Gauss's rule up
    to where the integrand has fallen by exp(-40)."""
    left = math.exp(-40.0 / power) if power > 0 else 0.0
    fall = -math.expm1(-80.0 / power) if power > 0 else 1.0
    high = math.atan2(math.sqrt(math.sin(low) ** 2 + math.cos(low) ** 2 * fall), math.cos(low) * left)
    x = low + (high - low) * (_NODES + 1) / 2
    return float((_WEIGHTS * np.exp(power * (_log_cos(x) - _log_cos(low)))).sum() * (high - low) / 2)


def t_two_sided_p(t: float | None, df: float | None) -> float:
    """Two-sided p-value of Student's t: with ``angle = atan(t / sqrt(df))`` the density becomes a
    power of the cosine, and p the share of its integral beyond the angle.  One form for all
    degrees of freedom, from 1 to where t is normal."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df < 1 or math.isinf(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    angle = math.atan(abs(t) / math.sqrt(df))
    there = math.exp((df - 1) * float(_log_cos(angle))) if df > 1 else 1.0
    return min(1.0, there * _tail(df - 1, angle) / _tail(df - 1, 0.0))


@F.pandas_udf(DoubleType())
def t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b))
                      for a, b in zip(t, df)], dtype="float64")


class PairSums:
    """Count, means of both sides, and mean and squared deviations of the differences, of every
    (candidate, baseline), added up block by block."""

    def __init__(self):
        self.names: tuple[dict, dict] = ({}, {})
        self.sums = np.zeros((5, 0, 0))  # n, sum of x, sum of y, mean of d, squared deviations of d

    def _grow(self) -> None:
        shape = (5, *(len(x) for x in self.names))
        grown = np.zeros(shape)
        grown[:, : self.sums.shape[1], : self.sums.shape[2]] = self.sums
        self.sums = grown

    def add(self, unit: np.ndarray, side: np.ndarray, model: np.ndarray, x: np.ndarray) -> None:
        """Rows of whole units: unit numbers from 0, side 0 for candidates and 1 for baselines."""
        height, values = int(unit.max()) + 1, []
        for i, names in enumerate(self.names):
            at = np.flatnonzero(side == i)
            columns = np.fromiter((names.setdefault(m, len(names)) for m in model[at]), np.int64, len(at))
            block = np.full((height, len(names)), np.nan)
            block[unit[at], columns] = x[at]
            values.append(block)
        self._grow()
        xs, ys = values
        seen = [~np.isnan(v) for v in values]
        mx, my = (m.astype(float) for m in seen)
        n = mx.T @ my
        self.sums[1] += np.where(seen[0], xs, 0).T @ my
        self.sums[2] += mx.T @ np.where(seen[1], ys, 0)
        for c in range(xs.shape[1]):  # differences of one candidate: units x baselines
            d = xs[:, c: c + 1] - ys
            both = ~np.isnan(d)
            # seen from one of its own differences, a constant difference has no deviation at all
            origin = np.take_along_axis(d, both.argmax(0)[None], 0)[0] if height else np.zeros(d.shape[1])
            d = np.where(both, d - origin, 0.0)
            count = np.maximum(n[c], 1)
            off = d.sum(0) / count
            square = np.maximum((d * d).sum(0) - count * off * off, 0)
            self._merge(c, n[c], np.where(n[c] > 0, origin + off, 0.0), np.where(n[c] > 0, square, 0.0))

    def _merge(self, c: int, n: np.ndarray, mean: np.ndarray, square: np.ndarray) -> None:
        held = self.sums[0, c]
        total = np.maximum(held + n, 1)
        apart = np.where((held > 0) & (n > 0), mean - self.sums[3, c], 0.0)
        self.sums[3, c] = np.where(held > 0, self.sums[3, c] + apart * n / total, mean)
        self.sums[4, c] += square + apart * apart * held * n / total
        self.sums[0, c] += n

    def batch(self) -> pa.RecordBatch:
        c, b = np.nonzero(self.sums[0])
        slm, base = (np.array(list(x), object) for x in self.names)
        columns = [slm[c] if len(c) else [], base[b] if len(b) else []]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.string()) for x in columns), pa.array(self.sums[0][c, b].astype(np.int64)),
             *(pa.array(self.sums[i][c, b]) for i in range(1, 5))], names=["slm", "llm_baseline", "n", "sx", "sy", "mean", "square"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit -> one row per pair of the partition."""
    sums, held, units = PairSums(), [], 0

    def flush(rows: list[pd.DataFrame]) -> None:
        block = pd.concat(rows)
        sums.add(pd.factorize(block["unit"])[0], block["side"].to_numpy(), block["model"].to_numpy(), block["x"].to_numpy(float))

    for batch in batches:
        rows = batch.to_pandas()
        if rows.empty:
            continue
        held.append(rows)
        units += rows["unit"].nunique()
        if units >= BLOCK_UNITS:  # the last unit may go on in the next batch
            block = pd.concat(held)
            last = block["unit"] == block["unit"].iloc[-1]
            if not last.all():
                flush([block[~last]])
            held, units = [block[last]], 1
    if held:
        flush(held)
    if sums.sums[0].any():
        yield sums.batch()


def pair_stats(scores: DataFrame, is_candidate: Column, model: str = "model", unit: str = "unit",
               score: str = "score") -> DataFrame:
    """Per (candidate, baseline): means over matched units, mean and sample std of the paired
    difference, number of matched units.  A unit's scores of one model are averaged first."""
    rows = scores.groupBy(model, unit).agg(F.avg(score).alias("x")).filter(F.col("x").isNotNull() & F.col(unit).isNotNull()
                                                                     & is_candidate.isNotNull())
    rows = rows.select(F.col(unit).cast("string").alias("unit"), F.when(is_candidate, 0).otherwise(1).alias("side"),
                       F.col(model).cast("string").alias("model"), F.col("x").cast("double").alias("x"))
    sums = rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _pair_sums, "slm string, llm_baseline string, n long, sx double, sy double, mean double, square double")
    # parts are merged around one of their own means, which leaves equal means without deviation
    pair = ["slm", "llm_baseline"]
    sums = sums.withColumn("origin", F.min("mean").over(Window.partitionBy(*pair)))
    off = F.col("mean") - F.col("origin")
    g = sums.groupBy(*pair).agg(F.sum("n").alias("n_pairs"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"),
                                F.sum(F.col("n") * off).alias("off"), F.min("origin").alias("origin"),
                                F.sum(F.col("square") + F.col("n") * off * off).alias("square"))
    mean_off = F.col("off") / F.col("n_pairs")
    square = F.greatest(F.col("square") - F.col("off") * mean_off, F.lit(0.0))
    return g.select(*pair, (F.col("sx") / F.col("n_pairs")).alias("slm_mean_accuracy"),
                    (F.col("sy") / F.col("n_pairs")).alias("llm_mean_accuracy"), (F.col("origin") + mean_off).alias("mean_difference"),
                    F.when(F.col("n_pairs") > 1, F.sqrt(square / (F.col("n_pairs") - 1))).alias("sd_difference"), "n_pairs")


def pair_grid(scores: DataFrame, is_candidate: Column, model: str = "model", unit: str = "unit",
              score: str = "score") -> DataFrame:
    """T4: the candidate x baseline grid with the number of matched units per pair."""
    return pair_stats(scores, is_candidate, model, unit, score) \
        .select("slm", "llm_baseline", F.col("n_pairs").alias("n_units"))


def paired_t(scores: DataFrame, is_candidate: Column, model: str = "model", unit: str = "unit",
             score: str = "score", with_p: bool = True, alpha: float = 0.05) -> DataFrame:
    """T1 (+T2, T3): paired t statistic per (candidate, baseline) over matched units."""
    g = pair_stats(scores, is_candidate, model, unit, score)
    t = F.try_divide(F.col("mean_difference"), F.col("sd_difference") / F.sqrt(F.col("n_pairs").cast("double")))
    g = g.withColumn("t_statistic", t)
    if with_p:
        g = g.withColumn("p_value", t_pvalue_udf(F.col("t_statistic"), (F.col("n_pairs") - 1).cast("double")))
        g = g.withColumn("significant_at_0_05", F.col("p_value") < F.lit(alpha))
    return g


def significance_table(matrix: DataFrame, is_candidate: Column, alpha: float = 0.05) -> DataFrame:
    """Benchmark matrix -> significance table: the task is the pairing unit, values are rounded to
    4 decimals, significance is judged before rounding."""
    g = paired_t(matrix, is_candidate, "model", "task", "accuracy", alpha=alpha)
    means = ["slm_mean_accuracy", "llm_mean_accuracy", "mean_difference", "t_statistic", "p_value"]
    return g.select("slm", "llm_baseline", *[F.round(c, 4).alias(c) for c in means],
                    F.col("significant_at_0_05").alias("significant_at_0.05"), F.col("n_pairs").cast("int").alias("n_pairs"))
