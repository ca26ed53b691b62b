"""Result tables as CSV with a header (``inf`` is a valid double, blank is NULL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from evalspark.schemas import MATRIX_SCHEMA


def read_results_csv(spark: SparkSession, path: str, schema: StructType = MATRIX_SCHEMA) -> DataFrame:
    """Explicit schema (never inferred: inference types a column holding ``inf`` as string);
    ``inf`` / ``-inf`` parse to +/-Infinity, empty fields to NULL."""
    return (spark.read.schema(schema).option("header", True)
            .option("positiveInf", "inf").option("negativeInf", "-inf").option("nanValue", "nan")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("mode", "FAILFAST").csv(path))


def write_results_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV; ``inf`` written as ``inf`` so ``read_results_csv`` round-trips it."""
    (df.write.mode(mode).option("header", True)
     .option("positiveInf", "inf").option("negativeInf", "-inf").option("nanValue", "nan")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
