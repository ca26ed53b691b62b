"""Operator 8: quality classifier on random-indexing word vectors.

Words live in a hashed vocabulary of fixed size.  Every word has a sparse random index vector
(two entries of +1 or -1, from a hash); its word vector is the sum of the index vectors of the
words around it, over the whole corpus, plus its own.  A document is the mean of its words'
normalised vectors.  A two-layer numpy network maps that to a probability, whose temperature is
fitted on training rows set aside.

The stream of words has punctuation runs as words of their own, and after a word that is
capitalised, in capitals, a number, or the same as the word before, a mark of that.

Word vectors cover all given documents.  The network is fitted on at most ``sample`` labelled
rows, those with the smallest hashes of their ids.

Defined results: NULL and empty texts are scored as a document without words; rows with a NULL
id are scored, never trained on, and not held out; repeated labels count once, contradictory
ones not at all; without usable labels every score is 0.5; other columns play no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import U64, RunningHash, bound_batches, mix, released, table, to_bytes

#: Hashed vocabulary and dimensions of word vectors (a matrix of 2 MB, also what a task adds up).
VOCABULARY = 1 << 14
DIMENSIONS = 32
#: Vocabulary codes kept for marks and punctuation.
RESERVED = 256
#: Words on either side that make a word's context.
CONTEXT = 2
#: Most labelled rows that the network is fitted on.
SAMPLE = 20_000
#: Bytes of text handled at a time inside a task.
CHUNK_BYTES = 300_000

_SPACE, _MARK, _DIGIT, _LOWER, _UPPER = range(5)
_CLASS = np.array([_SPACE if b <= 0x20 else _DIGIT if 0x30 <= b <= 0x39 else _UPPER if 0x41 <= b <= 0x5A
                   else _LOWER if 0x61 <= b <= 0x7A or b >= 0x80 else _MARK for b in range(256)], np.uint8)
_SMALL = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_BASE = 0xA0761D6478BD642F


def word_codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word stream of some texts: flat codes and the text each belongs to."""
    raw = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    text = np.repeat(np.arange(len(texts)), [len(t or b"") + 1 for t in texts])
    kind = _CLASS[raw]
    group = np.where(kind >= _DIGIT, 2, kind)  # space, punctuation, word
    edge = np.r_[0, np.flatnonzero((group[1:] != group[:-1]) | (text[1:] != text[:-1])) + 1]
    start, end = edge, np.r_[edge[1:], len(raw)]
    token = group[start] != _SPACE
    start, end = start[token], end[token]
    is_word = group[start] == 2
    h = RunningHash(mix(_SMALL[raw].astype(U64) + U64(1)), _BASE).of(start, end)
    upper, digit = (np.r_[0, np.cumsum(kind == k)] for k in (_UPPER, _DIGIT))
    n_upper = upper[end] - upper[start]
    capitals = (n_upper > 1) & (n_upper == end - start - (digit[end] - digit[start]))
    shape = np.where(digit[end] - digit[start] == end - start, 3, np.where(capitals, 2, kind[start] == _UPPER))
    words = np.flatnonzero(is_word)
    again = np.zeros(len(start), bool)
    again[words[1:]] = (h[words[1:]] == h[words[:-1]]) & (text[start[words[1:]]] == text[start[words[:-1]]])
    mark = np.where(is_word, shape + 4 * again, 0)
    code = np.where(is_word, RESERVED + h % U64(VOCABULARY - RESERVED), 8 + h % U64(RESERVED - 8)).astype(np.int64)
    both = np.stack([code, mark], axis=1).ravel()
    return both[both > 0], np.repeat(text[start], 2)[both > 0]


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each code the places and signs of its index vector."""
    h = mix(np.arange(VOCABULARY, dtype=U64) + U64(0x5851F42D4C957F2D))
    at = np.stack([h % U64(DIMENSIONS), (h >> U64(20)) % U64(DIMENSIONS)], axis=1).astype(np.int64)
    sign = np.stack([(h >> U64(40)) & U64(1), (h >> U64(41)) & U64(1)], axis=1).astype(np.float64) * 2 - 1
    at[0], sign[0] = 0, 0  # code 0 separates texts
    return at, sign


def _chunks(column: pa.Array) -> Iterator[tuple[int, list]]:
    """Runs of rows of bounded size: (first row, texts)."""
    texts, low, held = to_bytes(column), 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"") + 1
        if held >= CHUNK_BYTES or i == len(texts) - 1:
            yield low, texts[low: i + 1]
            low, held = i + 1, 0


def word_vectors(texts: DataFrame, blocks: int = 32) -> np.ndarray:
    """Word vectors of length 1 for all codes, from every text of a one-column table.  Tasks add up
    their own matrix, the blocks of all tasks' matrices are summed by block."""
    rows = VOCABULARY // blocks

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = _index_vectors()
        total = np.zeros(VOCABULARY * DIMENSIONS)
        for batch in batches:
            for _, some in _chunks(batch.column(0)):
                codes, text = word_codes(some)
                if not len(codes):
                    continue
                # two separators before each text, so that no context crosses texts
                spaced = np.zeros(len(codes) + 2 * (text[-1] + 2), np.int64)
                spaced[np.arange(len(codes)) + 2 * (text + 1)] = codes
                pairs = [(spaced, spaced)]
                for k in range(1, CONTEXT + 1):
                    pairs += [(spaced[k:], spaced[:-k]), (spaced[:-k], spaced[k:])]
                for word, near in pairs:
                    for j in range(2):
                        total += np.bincount(word * DIMENSIONS + at[near, j], sign[near, j], len(total))
        parts = total.astype(np.int64).astype(np.int32).reshape(blocks, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks)), pa.array([p.tobytes() for p in parts], pa.binary())],
                                         names=["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(part, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(
            [s.tobytes() for s in sums.values()], pa.binary())], names=["block", "part"])

    schema = "block long, part binary"
    out = np.zeros((VOCABULARY, DIMENSIONS))
    # a task's blocks add up within it; a fixed 4 MB reach the driver
    for r in texts.mapInArrow(released(gather), schema).repartition(blocks, "block").mapInArrow(released(add), schema).collect():
        out[r["block"] * rows: (r["block"] + 1) * rows] = np.frombuffer(r["part"], np.int64).reshape(rows, DIMENSIONS)
    out[0] = 0
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pool(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each text; zeros without words."""
    codes, text = word_codes(texts)
    out = np.zeros((len(texts), vectors.shape[1]))
    if len(codes):
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        sums = np.add.reduceat(vectors[codes], first, axis=0, dtype=np.float64)
        out[text[first]] = sums / np.diff(np.r_[first, len(codes)])[:, None]
    return out


class Network:
    """Two layers: tanh units, then a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = 24, epochs: int = 60,
                 rate: float = 0.01, decay: float = 1e-4, seed: int = 8):
        rng = np.random.default_rng(seed)
        fit = ~aside if (~aside).any() else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        d = x.shape[1]
        self.w = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.temperature = 1.0
        z, t = self._standard(x[fit]), y[fit]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(t))
            for at in np.array_split(order, max(1, len(t) // 128)):
                a, b, c, e = self.w
                h = np.tanh(z[at] @ a + b)
                delta = (1 / (1 + np.exp(-(h @ c + e))) - t[at]) / len(at)
                back = np.outer(delta, c) * (1 - h * h)
                grads = [z[at].T @ back + decay * a, back.sum(0), h.T @ delta + decay * c, delta.sum(keepdims=True)]
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in enumerate(grads):  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        if aside.any():
            self.temperature = fit_temperature(np.stack([np.zeros(aside.sum()), self._logit(x[aside])], axis=1),
                                               y[aside].astype(int))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, e = self.w
        return np.tanh(self._standard(x) @ a + b) @ c + e

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -500, 500)))


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its log."""
    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(label)), label]).mean())

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def _training_rows(docs: DataFrame, labels: DataFrame, sample: int, train: F.Column | None) -> DataFrame:
    """(id, text, label) of at most ``sample`` labelled ids."""
    known = labels.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    known = known.where("label = high AND id IS NOT NULL").select("id", "label")
    if train is not None:
        known = known.where(train)
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    return docs.join(F.broadcast(chosen), "id").select("id", "text", "label")  # bounded by sample


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, sample: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, Network | None]:
    """Word vectors and network.  ``train``: a condition on the column id of rows to learn from."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vectors = word_vectors(rows.select("text"))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label IS NOT NULL")

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _chunks(batch.column(1)):
                part = batch.slice(low, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(list(pool(texts, sent.value)), pa.list_(pa.float64()))],
                    names=["id", "label", "x"])

    got = _training_rows(rows, known, sample, train).withColumn("label", F.col("label").cast("double"))
    kind = rows.schema["id"].dataType.simpleString()
    got = got.mapInArrow(released(pooled), f"id {kind}, label double, x array<double>")
    got = got.orderBy(F.xxhash64("id"), "id", "x").limit(sample)  # an id may stand in any number of rows
    got = sorted(got.collect(), key=lambda r: (r["id"], r["x"]))
    if not got:
        return vectors, None
    x, y = np.array([r["x"] for r in got]), np.array([r["label"] for r in got])
    return vectors, Network(x, y, np.arange(len(y)) % 5 == 0)


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``docs`` with the column score; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))
    docs = docs.drop("score")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for batch in batches:
            for low, texts in _chunks(batch.column(0).field(text_col)):
                p = network.probability(pool(texts, vectors)) if network else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), pa.array(p)],
                                                 names=["row", "score"])

    return rows.mapInArrow(released(run), f"row {kind}, score double").select("row.*", "score")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score and predicted; learns outside fold 1 of 3."""
    vectors, network = fit(docs, labels, fold("id", 3) != 1)
    return score(docs, vectors, network).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classified(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE: dict[str, str] = {}
