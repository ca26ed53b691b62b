"""Session helpers: one place that builds a SparkSession and finds shared scratch space."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces partitions at runtime,
# skew-join splits hot partitions, UTC keeps timestamps comparable with the DuckDB oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole documents can be ~100 KB each: keep one Arrow batch in a Python worker ~100 MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "evalspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  On a cluster pass ``master=None`` so the launcher decides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names (``spark.checkpoint.dir``).  Where none
    is named, a folder in the warehouse; on a cluster that must not be a folder of one machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = qualified(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
        if configured.startswith("file:") and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it (``fs.defaultFS`` where it names none)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(hadoop).toString()


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a ``qualified`` path and the place in it, for use inside tasks."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} names no file system")
    return fs.FileSystem.from_uri(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/evalspark-{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver tables (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
