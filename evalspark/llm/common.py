"""Helpers shared by the training-data operators: table access, scratch tables in the shared
folder, Arrow batch sizes, and hashing of words.

Word hashes are xxh3 64-bit values.  Where two different texts must not be taken for one
another, two independent 64-bit values are compared (128 bits)."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from evalspark.session import read_table, scratch_path

#: Rows in one Arrow batch; whole texts must fit in a Python worker, so batches stay small.
BATCH_ROWS = 1000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also bounds the Arrow batches of this session."""
    bound_batches(spark)
    return read_table(spark, sf_dir, name)


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: cuts lineage, and a
    lost executor costs no recomputation of what stands before.  The shuffle files behind it are
    not needed any more; Spark deletes them once the driver has collected its garbage, which is
    asked for here, as a driver with a quiet heap would let them pile up.  ``options`` go to the
    writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options or {}).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def released(run: Callable) -> Callable:
    """A task function that gives the memory it has freed back to the system when it ends: its
    Python worker lives on, and what it keeps for itself adds up over the stages of a job."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
            ctypes.CDLL(None).malloc_trim(0)

    return task


def to_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def word_hashes(words: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=count)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and xor-shift rounds)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class RunningHash:
    """Polynomial hashes (modulo 2**64) of any stretch of a sequence of word hashes, in O(1)
    each: the difference of two prefix sums, divided by a power of the odd base."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes) + 1
        up, down = self._powers.get(base, (np.ones(1, U64), np.ones(1, U64)))
        if len(up) < n:
            size = max(n, 2 * len(up))
            inverse = pow(base, -1, 1 << 64)
            up = np.cumprod(np.r_[U64(1), np.full(size, base, U64)])
            down = np.cumprod(np.r_[U64(1), np.full(size, inverse, U64)])
            self._powers[base] = (up, down)
        self.down = down
        self.sums = np.zeros(n, U64)
        np.cumsum(hashes * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)
