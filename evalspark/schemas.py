"""Explicit StructTypes of the data model."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MATRIX_SCHEMA = StructType([
    StructField("model", StringType()), StructField("task", StringType()), StructField("method", StringType()),
    StructField("accuracy", DoubleType()), StructField("latency_ms", DoubleType()),
    StructField("cost_per_1m_tokens", DoubleType()), StructField("privacy_risk", StringType()),
    StructField("roi_breakeven_tokens", DoubleType()),
])

RUN_SCHEMA = StructType([
    StructField("run_id", StringType()), StructField("experiment", StringType()),
    StructField("start_time", TimestampType()),
    StructField("tags", MapType(StringType(), StringType())),
    StructField("params", MapType(StringType(), StringType())),
    StructField("metrics", MapType(StringType(), DoubleType())),
])
