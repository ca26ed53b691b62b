"""Operator 9: approximate nearest neighbours by multi-index hashing.

Vectors get binary codes from a learned rotation (principal axes, then the rotation that brings
the projections nearest to their signs).  A code is split into substrings, and each substring
is indexed.  A code within Hamming radius r of a query has a substring within r / parts of the
query's, so probing the buckets that near retrieves every code within r; those are reranked by
the exact Euclidean distance of the original vectors in double precision.

The radius is measured: for a bounded number of queries the true neighbours are found by brute
force over all rows, and r is the given quantile of their Hamming distances (``reach``).  Queries
with fewer than k rows within r are searched again with a growing radius, up to the code's length,
which covers every row; so each query gets k rows, or all there are.

The index is a written table of segments, each a block of rows with the buckets of every
substring.  Queries go against all segments in blocks of bounded size; each segment returns its
nearest few per query, and the best of those are kept.

Defined results: vectors that are NULL, zero, or that hold a NULL or non-finite component take no
part, nor do rows with a NULL id; vectors of different lengths have no distance, so each length
is searched by itself; an id counts as one row, at
its nearest vector, and as a query with its smallest vector; ties go to the smaller id; other
columns play no part."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import bound_batches, scratch, table

#: Vectors on which the rotation is learned.
SAMPLE = 10_000
#: Longest code, in bits, and the substrings it is split into.
BITS, PARTS = 64, 4
#: Queries whose true neighbours are found by brute force to set the radius.
PROBES = 60
#: Share of true neighbours within the radius.
REACH = 0.97
#: Rows of one index segment; queries broadcast at a time.
SEGMENT_ROWS = 50_000
BLOCK_QUERIES = 20_000


class Codes:
    """A learned map from vectors to binary codes, as ``parts`` integers each."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, parts: int = PARTS, rounds: int = 30, seed: int = 9):
        self.mean = sample.mean(0)
        x = sample - self.mean
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(bits, x.shape[1])]
        x = x @ axes
        rng = np.random.default_rng(seed)
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(x @ turn).T @ x)
            turn = (u @ v).T
        self.map = axes @ turn
        self.cuts = np.array_split(np.arange(self.map.shape[1]), min(parts, self.map.shape[1]))

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts) of substrings."""
        bit = ((x - self.mean) @ self.map) > 0
        return np.stack([bit[:, c] @ (1 << np.arange(len(c), dtype=np.int64)) for c in self.cuts], axis=1)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    good = ("id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf'))"
            " AND exists(x, v -> v <> 0)")
    return rows.where(good)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def build_index(rows: DataFrame, codes: Codes, segment_rows: int) -> DataFrame:
    """One row per segment: ids, vectors, and for each part its bucket values, where each bucket
    starts, and the rows in bucket order."""
    sent = rows.sparkSession.sparkContext.broadcast(codes)
    ddl = ("ids array<long>, vectors binary, parts array<struct<values:array<long>,starts:array<int>,rows:array<int>>>")
    kind = pa.list_(pa.struct([("values", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())),
                               ("rows", pa.list_(pa.int32()))]))

    def segment(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        parts = []
        for part in sent.value.of(x).T:
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            parts.append({"values": values, "starts": np.append(starts, len(part)), "rows": order})
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()),
                                           pa.array([parts], kind)], names=["ids", "vectors", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1))))
            if sum(len(h[0]) for h in held) >= segment_rows:
                yield segment(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if held:
            yield segment(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return scratch(rows.mapInArrow(run, ddl), "vector-index")


class Segment:
    def __init__(self, batch: pa.RecordBatch, i: int):
        self.ids = batch.column("ids")[i].values.to_numpy()
        self.x = np.frombuffer(batch.column("vectors")[i].as_py()).reshape(len(self.ids), -1)
        parts = batch.column("parts")[i].values
        self.parts = [tuple(np.asarray(p[c].values) for c in ("values", "starts", "rows")) for p in parts]

    @cached_property
    def codes(self) -> np.ndarray:
        """The whole code of every row, in row order."""
        out = np.zeros((len(self.ids), len(self.parts)), np.int64)
        for j, (values, starts, rows) in enumerate(self.parts):
            out[rows, j] = np.repeat(values, np.diff(starts))
        return out

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius`` of ``code``: rows of buckets within the part's
        share of the radius in any part; whole codes are compared for those rows only."""
        near = np.zeros(len(self.ids), bool)
        for (values, starts, rows), q in zip(self.parts, code, strict=True):
            hit = np.flatnonzero(np.bitwise_count(values ^ q) <= radius // len(self.parts))
            size = starts[hit + 1] - starts[hit]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            near[rows[np.repeat(starts[hit], size) + within]] = True
        rows = np.flatnonzero(near)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]

    def nearest(self, rows: np.ndarray, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of ``rows`` to ``q``, each id once: (row, id, distance)."""
        rows = rows[self.ids[rows] != query]
        d, ids = distances(self.x[rows], q), self.ids[rows]
        if len(rows) > 4 * k and len(np.unique(ids)) == len(ids):
            keep = d <= np.partition(d, k - 1)[k - 1]
            rows, d, ids = rows[keep], d[keep], ids[keep]
        order = np.lexsort((ids, d))
        first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
        return rows[order[first]], ids[order[first]], d[order[first]]


def _search(index: DataFrame, ids: np.ndarray, x: np.ndarray, codes: Codes, k: int, radius: int | None) -> DataFrame:
    """(query_id, vec_id, score, bits) of each segment's k nearest per query; bits is the Hamming
    distance.  Without radius: of all rows, by brute force."""
    sent = index.sparkSession.sparkContext.broadcast((ids, x, codes.of(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Segment(batch, i)
                every, out = np.arange(len(part.ids)), []
                for query, q, c in zip(*sent.value, strict=True):
                    rows = every if radius is None else part.probe(c, radius)
                    rows, found, d = part.nearest(rows, query, q, k)
                    out.append((np.full(len(found), query), found, d, np.bitwise_count(part.codes[rows] ^ c).sum(1, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*out, strict=True)],
                                                 names=["query_id", "vec_id", "score", "bits"])

    found = index.mapInArrow(run, "query_id long, vec_id long, score double, bits int")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.min("bits").alias("bits"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, reach: float = REACH, sample: int = SAMPLE,
            probes: int = PROBES, segment_rows: int = SEGMENT_ROWS, block_queries: int = BLOCK_QUERIES,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` found for each of
    ``queries``, its own id left out."""
    spark = vectors.sparkSession
    bound_batches(spark)
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, wanted = (_usable(v, id_col, vec_col) for v in (vectors, queries))
    # vectors of different lengths have no distance: each length that is asked for has its index
    widths = wanted.select(F.size("x").alias("w")).distinct().orderBy("w").collect()
    for r in widths:
        of = F.size("x") == r["w"]
        part = _nearest_of(rows.where(of), wanted.where(of), r["w"], k, reach, sample, probes, segment_rows, block_queries)
        found = part if len(widths) == 1 else found.unionByName(part)
    return found


def _nearest_of(rows: DataFrame, wanted: DataFrame, width: int, k: int, reach: float, sample: int, probes: int,
                segment_rows: int, block_queries: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    spark = rows.sparkSession
    some = rows.orderBy(F.xxhash64("id"), "id", "x").limit(sample).collect()
    codes = Codes(np.array([r["x"] for r in some]))
    index = build_index(rows, codes, segment_rows)
    wanted = wanted.groupBy("id").agg(F.min("x").alias("x"))

    def arrays(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = sorted((r["id"], r["x"]) for r in part.collect())
        return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got]).reshape(len(got), width)

    ids, x = arrays(wanted.orderBy(F.xxhash64("id")).limit(probes))
    true = [r["bits"] for r in _search(index, ids, x, codes, k, None).select("bits").collect()]
    radius = int(np.quantile(true, reach, method="higher")) if true else 0

    blocks = max(1, math.ceil(wanted.count() / block_queries))
    found = None
    for i in range(blocks):
        ids, x = arrays(wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else wanted)
        near = radius
        while len(ids):
            part = scratch(_search(index, ids, x, codes, k, near), "neighbours")
            short = np.zeros(len(ids), bool)
            if near < codes.map.shape[1]:  # a radius of the code's length covers every row
                full = {r["query_id"] for r in part.groupBy("query_id").count().where(F.col("count") >= k).collect()}
                short = np.array([i not in full for i in ids.tolist()])
            if short.any():
                again = spark.createDataFrame([(i,) for i in ids[short].tolist()], "query_id long")
                part = part.join(again, "query_id", "left_anti")
            found = part if found is None else found.unionByName(part)
            ids, x, near = ids[short], x[short], min(2 * near + 1, codes.map.shape[1])
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op9_nearest_neighbours": op9_nearest_neighbours}
ORACLE: dict[str, str] = {}
