import math

import numpy as np

from evalspark.llm import neighbours


def brute(rows, queries, k=10):
    out = {}
    for q, x in queries:
        found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), i) for i, y in rows if i != q)
        out[q] = found[:k]
    return out


def by_query(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    for found in out.values():
        assert sorted(found) == list(range(1, len(found) + 1))
        assert [found[k] for k in sorted(found)] == sorted(found.values())
    return {q: [found[k] for k in sorted(found)] for q, found in out.items()}


def test_recall_and_exact_scores(spark, sf):
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = by_query(neighbours.op9_nearest_neighbours(spark, sf))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    at = dict(rows)
    for q, found in got.items():
        for d, i in found:
            assert math.isclose(d, math.dist(at[q], at[i]), rel_tol=1e-12)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24))
    codes = neighbours.Codes(x, bits=24, parts=3)
    c = codes.of(x)
    segment = neighbours.Segment.__new__(neighbours.Segment)
    segment.ids, segment.parts = np.arange(400), []
    for part in c.T:
        order = np.argsort(part, kind="stable")
        values, starts = np.unique(part[order], return_index=True)
        segment.parts.append((values, np.append(starts, 400), order))
    bits = np.bitwise_count(c[:, None] ^ c).sum(-1)
    for q in range(0, 400, 37):
        for radius in (0, 2, 5, 9):
            assert segment.probe(c[q], radius).tolist() == np.flatnonzero(bits[q] <= radius).tolist()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (100, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.5]), (2, [1.0, 0.0, 2.5]),
            (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, []),
            (9, [1.0]), (None, [1.0, 1.0, 1.0]), (200, None), (10, [-5.0, 1.0, 1.0]), (11, [1.0, 0.0, 1.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = by_query(neighbours.nearest(frame, frame.where("vec_id % 100 = 0"), reach=1.0, segment_rows=2, block_queries=1))
    good = [(0, rows[0][1]), (100, rows[1][1]), (1, rows[2][1]), (2, rows[3][1]), (10, rows[14][1]), (11, rows[15][1])]
    assert got == brute(good, good[:2])


def test_empty_and_single(spark):
    schema = "vec_id long, embedding array<double>, query_id int, score string"
    none = spark.createDataFrame([], schema)
    assert neighbours.nearest(none, none).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0], 5, "x")], schema)
    assert neighbours.nearest(one, one).collect() == []
    two = spark.createDataFrame([(100, [1.0, 2.0], 5, "x"), (7, [1.0, 3.0], 5, "x")], schema)
    assert [tuple(r) for r in neighbours.nearest(two, two.where("vec_id = 100")).collect()] == [(100, 1, 7, 1.0)]
    assert neighbours.nearest(two, none).collect() == []


def test_copies_of_one_vector(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2), 0.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = by_query(neighbours.nearest(frame, frame.where("vec_id % 100 = 0"), segment_rows=64))
    assert [i for _, i in got[100]] == list(range(0, 20, 2)) and [i for _, i in got[0]] == list(range(2, 22, 2))


def test_queries_far_from_all_rows_get_their_k(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = [c + 0.001 * rng.normal(size=32) for c in centres for _ in range(30)] + list(3 * rng.normal(size=(8, 32)))
    ids = [*range(1, 1201), *range(9000, 9800, 100)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = by_query(neighbours.nearest(frame, frame.where("vec_id % 100 = 0"), segment_rows=300, block_queries=7))
    assert {q: len(found) for q, found in got.items()} == {i: 10 for i in ids if i % 100 == 0}
    few = frame.where("vec_id % 150 = 0 OR vec_id >= 9000")
    got, rest = by_query(neighbours.nearest(few, few, k=40)), few.count() - 1
    assert len(got) == rest + 1 and all(len(found) == rest for found in got.values())
