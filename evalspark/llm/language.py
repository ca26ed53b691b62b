"""Operator 5: language identification.

Texts become TF-IDF vectors of hashed character 1- to 3-grams of their lower-cased letters (runs
of anything else are one space).  A sparse multinomial logistic regression is trained with
follow-the-regularised-leader and elastic-net penalties (the L1 part keeps weights at exactly
zero), then its temperature is fitted on training rows set aside.

Document frequencies come from all training rows.  The regression is fitted on at most
``per_language`` rows of each language, those with the smallest hashes of their ids.

Defined results: a NULL text or one without letters is ``und`` with score 1; so is every text,
with score 0, if there is no training row; rows with a NULL id or NULL language are predicted,
never trained on; repeated rows count each; texts of any length are read whole; lang, source and
doc_id are no inputs, other columns play no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import U64, bound_batches, mix, table
from evalspark.llm.quality import fit_temperature, fold

#: Hashed n-grams.
FEATURES = 1 << 15
#: Most rows of one language that the regression is fitted on.
PER_LANGUAGE = 2_500
UNKNOWN = "und"


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, other runs as one space, spaces at both ends;
    empty if there are no letters."""
    if not text:
        return np.zeros(0, np.uint32)
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    is_letter = np.where(code < 128, (code >= 97) & (code <= 122), False)
    beyond = np.flatnonzero(code >= 128)
    if len(beyond):
        values, where = np.unique(code[beyond], return_inverse=True)
        is_letter[beyond] = np.array([chr(v).isalpha() for v in values])[where]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    code = np.where(is_letter, code, 32).astype(np.uint32)
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    return code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    c = letters(text).astype(U64)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, parts = np.zeros(len(c), U64), []
    for n in range(1, 4):
        h = h[: len(c) - n + 1] * U64(0x9E3779B97F4A7C15) + c[n - 1:] + U64(n << 32)
        parts.append((mix(h) & U64(FEATURES - 1)).astype(np.int64))
        if len(c) == n:
            break
    count = np.bincount(np.concatenate(parts), minlength=FEATURES)
    at = np.flatnonzero(count)
    return at, count[at]


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length 1."""
    x = (1 + np.log(count)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


class Regression:
    """Sparse multinomial logistic regression, trained by FTRL-proximal."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, languages: list[str],
                 idf: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3,
                 epochs: int = 2, seed: int = 5):
        self.languages, self.idf, self.temperature = languages, idf.astype(np.float32), 1.0
        k = len(languages)
        z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
        rng = np.random.default_rng(seed)
        aside = np.arange(len(rows)) % 5 == 4
        xs = [weigh(at, count, idf).astype(np.float32) for at, count in rows]
        for _ in range(epochs):
            for i in rng.permutation(np.flatnonzero(~aside)):
                at, x = rows[i][0], xs[i]
                w = self._weights(z[at], n[at], alpha, beta, l1, l2)
                p = self._softmax(x @ w)
                p[label[i]] -= 1
                g = np.outer(x, p)
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
                z[at] += g - sigma * w
                n[at] += g * g
        self.w = self._weights(z, n, alpha, beta, l1, l2).astype(np.float32)
        if aside.any():
            logits = np.array([x @ self.w[rows[i][0]] for i, x in enumerate(xs) if aside[i]])
            self.temperature = fit_temperature(logits, label[aside])

    @staticmethod
    def _weights(z, n, alpha, beta, l1, l2):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        at, count = grams(text)
        if not len(at):
            return UNKNOWN, 1.0
        p = self._softmax((weigh(at, count, self.idf) @ self.w[at]).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(texts: DataFrame, blocks: int = 16) -> tuple[int, np.ndarray]:
    """How many texts have letters, and how many have each hashed n-gram.  Tasks count for
    themselves; blocks of the counts are summed (a fixed size in all)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(FEATURES, np.int64)
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = grams(text)
                n[at] += 1
                total += len(at) > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(blocks), blocks]), pa.array([*n.reshape(blocks, -1).tolist(), [total]], pa.list_(pa.int64()))],
            names=["block", "n"])

    parts = texts.mapInArrow(gather, "block long, n array<long>").select("block", F.posexplode("n").alias("at", "n"))
    n, total = np.zeros(FEATURES, np.int64), 0
    for r in parts.groupBy("block", "at").agg(F.sum("n").alias("n")).collect():
        if r["block"] == blocks:
            total = r["n"]
        else:
            n[r["block"] * (FEATURES // blocks) + r["at"]] = r["n"]
    return total, n


def fit(docs: DataFrame, train: F.Column | None = None, per_language: int = PER_LANGUAGE, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Regression | None:
    """``train``: a condition on the column id of rows to learn from."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    if train is not None:
        rows = rows.where(train)
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not size:
        return None
    total, df = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    ids = rows.select("id", "lang").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = ids.withColumn("place", place).where(F.col("place") <= per_language).select("id", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [grams(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()),
                 pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], names=["id", "lang", "at", "n"])

    sample = rows.join(chosen, ["id", "lang"]).select("id", "lang", "text")
    kind = rows.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(counted, f"id {kind}, lang string, at binary, n binary").where("octet_length(at) > 0")
    # an id may stand in any number of rows
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "at", "n"))
    got = got.withColumn("place", place).where(F.col("place") <= per_language).drop("place").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["id"], r["at"], r["n"]))
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    label = np.array([languages.index(r["lang"]) for r in got])
    return Regression([tuple(np.frombuffer(r[c], np.int32) for c in ("at", "n")) for r in got],
                      label, languages, idf)


def predict(docs: DataFrame, model: Regression | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of those names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = [model.predict(t) if model else (UNKNOWN, 0.0) for t in batch.column(0).field(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold("id", 4) != 2)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
