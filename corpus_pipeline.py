"""A training-corpus pipeline over the operators of ``evalspark.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result
is written as Parquet and read again.  All stages but the last return the columns of
``documents``; a missing decision (rows with NULL text, say) keeps the row.

1. quality: rows that the classifier scores below 0.5 go.
2. near_duplicates: of each component under Jaccard links the smallest doc_id stays.
3. substrings: words of repeated 50-word windows go; texts without repeats stay as they are,
   and n_chars follows the text.
4. decontaminate: documents that hold an exact window of a benchmark item go.
5. tokens: byte-level BPE ids with their digests, one row per document left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, decontaminate, jaccard, quality, substrings
from evalspark.llm.common import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classified(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id stay; of rows that repeat an id (and so are one document) the one with the
    smallest hash of its text stays, whatever the order of rows."""
    found = jaccard.jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi")
    others = [c for c in docs.columns if c != "doc_id"]
    rank = F.struct(F.sha2("text", 256).alias("text"), F.xxhash64(*others).alias("row"))
    kept = kept.groupBy("doc_id").agg(F.min_by(F.struct(*others), rank).alias("kept")).select("doc_id", "kept.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    cleaned = cleaned.withColumn("text", text)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("substrings", substring_stage),
          ("decontaminate", decontamination_stage), ("tokens", token_stage)]

ORACLE_SQL = None  # the classifier, the components and the tokeniser are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
