"""S3: load a task dataset by name and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.config import TASK_REGISTRY
from evalspark.operators.prepare import first_n, split2, split3

SPLITS = ("train", "validation", "test")


class UnknownTask(ValueError):
    pass


def load_task_dataset(spark: SparkSession, task: str, storage: dict, split: str | None = None,
                      max_samples: int | None = None, order_by: str | None = None,
                      registry: dict = TASK_REGISTRY) -> tuple[DataFrame, dict]:
    """The dataset of ``task`` and its configuration (columns, label map, prompt template).

    ``registry`` holds the tasks; ``storage[task]`` says where the data is and may replace any of
    the task's settings: ``path`` (one table) or ``paths`` (split -> table), ``format``
    (parquet/csv/json), ``schema``, ``id_col``.  Splits that storage lacks are carved out by
    seeded hash of ``id_col``: one table gives 80/10/10, ``paths`` with ``train`` and ``test`` only
    gives 90/10 of train for train and validation; ``split=None`` reads everything.

    Unknown task -> ``UnknownTask``; missing source, unknown split or missing columns ->
    ``ValueError`` before any job runs.  ``max_samples`` keeps the first N rows by ``order_by``."""
    if task not in storage and task not in registry:
        raise UnknownTask(f"unknown task {task!r}; known: {sorted({*registry, *storage})}")
    cfg = {**registry.get(task, {}), **storage.get(task, {})}
    paths = cfg.get("paths") or ({"all": cfg["path"]} if cfg.get("path") else None)
    if not paths:
        raise ValueError(f"no storage is given for {task!r}")
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; known: {SPLITS}")

    def read(path: str) -> DataFrame:
        reader = spark.read if cfg.get("schema") is None else spark.read.schema(cfg["schema"])
        fmt = cfg.get("format", "parquet")
        df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"dataset for {task!r} lacks required columns {missing}")
        return df.select(*required)

    required = [c for c in (cfg.get("id_col"), cfg["input_col"], cfg["label_col"]) if c]
    key = cfg.get("id_col") or cfg["input_col"]
    if split is None:
        df = None
        for path in paths.values():
            df = read(path) if df is None else df.unionByName(read(path))
    elif split in paths:
        df = read(paths[split])
        if split == "train" and "validation" not in paths:
            df = _carved(df, key, split)
    elif "all" in paths:
        df = split3(read(paths["all"]), key, col="_split").filter(F.col("_split") == split).drop("_split")
    elif split == "validation" and "train" in paths:
        df = _carved(read(paths["train"]), key, split)
    else:
        raise ValueError(f"storage of {task!r} has no {split!r} split")
    if max_samples is not None:
        df = first_n(df, max_samples, order_by or required[0])
    return df, cfg


def _carved(train: DataFrame, key: str, split: str) -> DataFrame:
    """90/10 of a training table for train and validation."""
    both = split2(train.withColumn("_source", F.lit("train")), key, source_col="_source", col="_split")
    return both.filter(F.col("_split") == split).drop("_source", "_split")
