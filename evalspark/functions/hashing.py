"""Deterministic hashing that is stable across partitionings, engines and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def h32(x) -> Column:
    """First 32 bits of md5(x) as a non-negative BIGINT (same value as DuckDB's
    ``('0x'||substr(md5(x),1,8))::bigint``)."""
    return F.conv(F.substring(F.md5(_c(x).cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key, seed: int | str = 42, buckets: int = 10000) -> Column:
    """Bucket in ``[0, buckets)`` from ``h32(seed || ':' || key)``: a narrow, seeded,
    repartition-invariant replacement for random splits."""
    return h32(F.concat(F.lit(str(seed)), F.lit(":"), _c(key).cast("string"))) % F.lit(buckets)
