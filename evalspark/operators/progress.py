"""Durable progress inside a scoring job (I1 + I2).

A task scores its samples in chunks.  Each finished chunk becomes a file of the result folder:
written under a hidden name, then renamed, so a chunk is there as a whole or not at all.  The
file's name is a hash of the chunk's keys.  Whoever meets the same chunk again (a task run a
second time, a twin of a slow task) finds the file and calls no model; a job started again
leaves out every key that is in the folder.  At most one unfinished chunk a task is ever lost.

The ledger lists the committed chunks with their ranges of keys and what a job did with them."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from evalspark.operators.pacing import RateLimit, Retry
from evalspark.operators.scoring import SCORE_FIELDS, Predictor, scorer_factory
from evalspark.session import open_folder, qualified

LEDGER = "_ledger"  # hidden from readers of the folder
LEDGER_SCHEMA = "chunk string, first_key string, last_key string, n_rows long, scored boolean"


def one_per_key(samples: DataFrame, keys: list[str], prompt_col: str) -> DataFrame:
    """One row for each key (NULL is a key too): of several the one with the smallest prompt."""
    others = [c for c in samples.columns if c not in keys]
    picked = samples.groupBy(*keys).agg(F.min_by(F.struct(*others), F.coalesce(F.col(prompt_col), F.lit(""))).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in samples.columns])


def without_scored(samples: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Samples whose key the folder does not hold; only the key columns of its files are read."""
    done = scored.select(*[F.col(c).alias(f"_done_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"_done_{c}")) for c in keys]
    return samples.join(done, same, "left_anti")


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches in order, in tables of ``rows`` rows; the last may be shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            take = min(rows - sum(b.num_rows for b in held), batch.num_rows)
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(b.num_rows for b in held) == rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _keys(table: pa.Table, keys: list[str]) -> list[str]:
    return ["\x1f".join("" if v is None else f"={v}" for v in row) for row in zip(*(table[c].to_pylist() for c in keys), strict=True)]


def score_durably(samples: DataFrame, predictor_factory: Callable[[], Predictor], key, folder: str,
                  prompt_col: str = "prompt", keep=None, chunk_rows: int = 200, num_partitions: int | None = None,
                  max_attempts: int = 3, sentinel: str = "error", batch_mode: bool = False, retry: Retry | None = None,
                  rate: RateLimit | None = None) -> DataFrame:
    """Scores every sample whose key ``folder`` does not hold yet (a job, not a plan), and returns
    all that the folder holds then: ``(key, keep, score columns)``, one row a key.

    ``folder`` must be reached by all executors.  A chunk holds ``chunk_rows`` samples."""
    spark = samples.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    keep = list(keep) if keep is not None else [c for c in samples.columns if c != prompt_col]
    names = keys + [c for c in keep if c not in keys]
    rows = samples.select(*names, F.col(prompt_col).alias("_prompt"))
    # every column nullable, as Parquet gives them back
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]] + SCORE_FIELDS)
    where = qualified(spark, folder)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(where)  # readers always find a table
    todo = without_scored(one_per_key(rows, keys, "_prompt"), spark.read.schema(schema).parquet(where), keys)
    lanes = num_partitions or (spark.sparkContext.defaultParallelism if rate else None)
    todo = todo.repartition(lanes, *keys) if lanes else todo.repartition(*keys)
    todo = todo.sortWithinPartitions(*keys)  # a task that is run again meets the same chunks
    build = scorer_factory(predictor_factory, lanes, rate, max_attempts=max_attempts, sentinel=sentinel,
                           batch_mode=batch_mode, retry=retry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(where)
        scorer = None
        for table in _tables(batches, chunk_rows):
            held = _keys(table, keys)
            name = hashlib.sha256("\x1e".join(held).encode()).hexdigest()[:32]
            path = f"{base}/chunk-{name}.parquet"
            missing = store.get_file_info(path).type.name == "NotFound"
            if missing:
                scorer = scorer or build()  # a task without work of its own loads no model
                table = table.combine_chunks()
                prompts = table["_prompt"].combine_chunks()
                prompts = prompts if isinstance(prompts, pa.Array) else pa.concat_arrays(prompts.chunks)
                out = pa.table([*table.drop_columns(["_prompt"]).columns, *scorer.columns(prompts)], names=schema.names)
                draft = f"{base}/_draft-{name}-{uuid.uuid4().hex[:8]}"
                pq.write_table(out, draft, filesystem=store)
                store.move(draft, path)
            yield pa.RecordBatch.from_pydict({"chunk": [name], "first_key": [held[0]], "last_key": [held[-1]],
                                              "n_rows": [len(held)], "scored": [missing]})

    todo.mapInArrow(run, LEDGER_SCHEMA).write.mode("append").parquet(os.path.join(where, LEDGER, uuid.uuid4().hex[:12]))
    return spark.read.schema(schema).parquet(where)


def read_ledger(spark, folder: str) -> DataFrame:
    """(chunk, first_key, last_key, n_rows, scored) of every job that ended."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(os.path.join(qualified(spark, folder), LEDGER, "*"))
