"""Scoring jobs around a model.

I1 applies a *user-supplied* predictor to every prompt with ``mapInArrow``: Spark partitions the
prompts, each Python worker builds the predictor once per partition and streams Arrow batches
through it.  Failures never abort the job: each row records ``attempts``, ``status`` and
``error`` (I4), and a failed row carries the ``error`` sentinel (I5).  Attempts wait in between,
and a provider's budget is shared by all tasks (``pacing``); no wait counts as latency.  No
network client ships with the library; tests use a deterministic function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from evalspark.functions.labels import is_error
from evalspark.operators.pacing import RateLimit, Retry, Turns

Predictor = Callable[[list], list]

SCORE_FIELDS = [
    StructField("prediction", StringType()),
    StructField("latency_s", DoubleType()),
    StructField("attempts", IntegerType()),
    StructField("batch_size", IntegerType()),
    StructField("status", StringType()),
    StructField("error", StringType()),
]
SCORE_TYPES = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string()]


class Scorer:
    """A predictor with its attempts, waits and turns: lists of prompts -> score columns."""

    def __init__(self, predict: Predictor, max_attempts: int = 3, sentinel: str = "error", batch_mode: bool = False,
                 retry: Retry | None = None, turns: Turns | None = None, sleep: Callable[[float], None] = time.sleep):
        self.predict, self.max_attempts, self.sentinel, self.batch_mode = predict, max_attempts, sentinel, batch_mode
        self.retry, self.turns, self.sleep = retry or Retry(), turns, sleep

    def _call(self, prompts: list[str]) -> tuple[list | None, float, Exception | None]:
        """Replies, latency and error of one call; its turn is taken before the timer starts."""
        if self.turns:
            self.turns.take(prompts)
        began = time.perf_counter()
        try:
            replies = list(self.predict(prompts))
            if len(replies) != len(prompts):  # rows could not be told apart
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompt{'s' * (len(prompts) > 1)}")
            return replies, time.perf_counter() - began, None
        except Exception as error:  # noqa: BLE001 - a failure is a result here
            return None, time.perf_counter() - began, error

    def one(self, prompt: str) -> tuple:
        for attempt in range(1, self.max_attempts + 1):
            replies, latency, error = self._call([prompt])
            if error is None:
                return replies[0], latency, attempt, 1, "ok", None
            if attempt == self.max_attempts or not self.retry.again(error):
                break
            self.sleep(self.retry.pause(attempt, error))
        return self.sentinel, latency, attempt, 1, "error", f"{type(error).__name__}: {error}"

    def all(self, prompts: list[str]) -> list[tuple]:
        """One row of score columns for each prompt.  A batch call has one timer, so its latency
        is shared out; if it fails, each prompt has its attempts by itself."""
        if self.batch_mode and prompts:
            replies, latency, error = self._call(prompts)
            if error is None:
                n = len(prompts)
                return [(reply, latency / n, 1, n, "ok", None) for reply in replies]
        return [self.one(p) for p in prompts]

    def columns(self, prompts: pa.Array) -> list[pa.Array]:
        rows = self.all([p if p is not None else "" for p in prompts.to_pylist()])
        columns = zip(*rows, strict=True) if rows else [()] * len(SCORE_TYPES)
        return [pa.array(c, t) for c, t in zip(columns, SCORE_TYPES, strict=True)]


def scorer_factory(predictor_factory: Callable[[], Predictor], lanes: int | None, rate: RateLimit | None,
                   **options) -> Callable[[], Scorer]:
    """Builds a task's scorer on its executor; the task's lane is its partition."""
    def build() -> Scorer:
        turns = Turns(rate, TaskContext.get().partitionId(), lanes) if rate else None
        return Scorer(predictor_factory(), turns=turns, **options)

    return build


def score(df: DataFrame, predictor_factory: Callable[[], Predictor], prompt_col: str = "prompt",
          keep=None, max_attempts: int = 3, sentinel: str = "error", batch_mode: bool = False,
          num_partitions: int | None = None, retry: Retry | None = None, rate: RateLimit | None = None) -> DataFrame:
    """``(keep..., prediction, latency_s, attempts, batch_size, status, error)`` per row.

    ``predictor_factory()`` returns ``predict(list[str]) -> list[str]``; it is called once per
    partition on the executors.  ``batch_mode`` sends a whole Arrow batch per call (latency
    is then amortised per row) and falls back to per-row retries if the batch call fails.
    ``num_partitions`` spreads the prompts over more tasks (model calls are the cost).
    ``retry`` sets the waits between attempts.  ``rate`` is the provider's budget, dealt to the
    partitions: give it no more of them than tasks can run at once (the default), since a
    partition that waits to be run leaves its share unused."""
    keep = list(keep) if keep is not None else [c for c in df.columns if c != prompt_col]
    src = df.select(*keep, F.col(prompt_col).alias("_prompt"))
    if rate and not num_partitions:
        num_partitions = df.sparkSession.sparkContext.defaultParallelism
    if num_partitions:
        src = src.repartition(num_partitions)
    schema = StructType([f for f in src.schema.fields if f.name != "_prompt"] + SCORE_FIELDS)
    build = scorer_factory(predictor_factory, num_partitions, rate, max_attempts=max_attempts, sentinel=sentinel,
                           batch_mode=batch_mode, retry=retry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = build()  # once per partition (model load / client set-up)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *scorer.columns(batch.column(batch.num_columns - 1))],
                                             names=schema.names)

    return src.mapInArrow(run, schema)


def resume(samples: DataFrame, done: DataFrame | None, key, required=()) -> DataFrame:
    """Samples not yet scored, by key (not by position).  A ``done`` table missing the
    key or a required column is unusable and ignored (everything is still to do)."""
    keys = [key] if isinstance(key, str) else list(key)
    if done is None or any(c not in done.columns for c in keys + list(required)):
        return samples
    return samples.join(done.select(*keys).distinct(), keys, "left_anti")


def failure_summary(scored: DataFrame, by=("model", "task"), status: str = "status",
                    error_value: str = "error") -> DataFrame:
    """I4: per unit, rows, failed rows and failure rate (algebraic aggregates)."""
    failed = (F.col(status) == error_value).cast("int")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(failed).cast("bigint").alias("n_failed")) \
        .withColumn("failure_rate", F.col("n_failed") / F.col("n"))


def with_status(preds: DataFrame, prediction: str = "prediction") -> DataFrame:
    """I4/I5 for logged predictions: ``status`` = error when the output is a failure sentinel."""
    return preds.withColumn("status", F.when(is_error(prediction), "error").otherwise("ok"))
