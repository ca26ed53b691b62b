"""ROUGE-L and stems over Arrow batches: what a worker holds does not grow with the batch."""
import random
import tracemalloc

import pyarrow as pa
import pytest

from evalspark.functions import porter
from evalspark.operators import rouge
from tools.plan_report import plan_text, summarize

WORDS = [a + b + c for a in ("walk", "relat", "happi", "connect", "gener", "cat") for b in ("", "ation", "ness", "er")
         for c in ("", "s", "ing", "ed")]


def batch(rows, size, seed=1):
    rnd = random.Random(seed)
    return pa.array([[rnd.choice(WORDS) for _ in range(size)] for _ in range(rows)], pa.list_(pa.string()))


def stems(tokens):
    return None if tokens is None else [porter.stem(t) if len(t) > 3 else t for t in tokens]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 18])
@pytest.mark.parametrize("stem", [False, True])
def test_runs_of_a_batch_give_the_rows_of_single_pairs(monkeypatch, at_once, stem):
    monkeypatch.setattr(rouge, "TOKENS_AT_ONCE", at_once)
    rnd = random.Random(3)
    x, y = ([None if rnd.random() < 0.2 else [rnd.choice(WORDS) for _ in range(rnd.randrange(6))] for _ in range(60)]
            for _ in range(2))
    kind = pa.list_(pa.string())
    got = (rouge.lcs_of_stems_udf if stem else rouge.lcs_udf).func
    f = stems if stem else lambda t: t
    want = [rouge.lcs_length(f(p) or [], f(q) or []) for p, q in zip(x, y)]
    assert got(pa.array(x, kind), pa.array(y, kind)).to_pylist() == want and any(want)
    assert got(pa.array(x, kind)[20:50], pa.array(y, kind)[20:50]).to_pylist() == want[20:50]
    assert rouge.stem_tokens_udf.func(pa.array(x, kind)).to_pylist() == [stems(t) for t in x]
    assert rouge.stem_tokens_udf.func(pa.array(x, kind)[20:50]).to_pylist() == [stems(t) for t in x[20:50]]
    none = pa.array([], kind)
    assert got(none, none).to_pylist() == rouge.stem_tokens_udf.func(none).to_pylist() == []


def test_python_objects_do_not_grow_with_the_batch():
    def peak(rows):
        a, b = batch(rows, 100), batch(rows, 100, seed=2)
        tracemalloc.start()
        try:
            rouge.lcs_of_stems_udf.func(a, b)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(9000) < 2 * peak(1500) + 1_000_000


def test_tokens_cross_to_python_once(spark):
    df = spark.createDataFrame([(1, "walks cats", "walking cat"), (2, None, "x"), (3, "", "")], "k int, reference string, prediction string")
    got = rouge.rouge_l(df, ["k"], stem=True)
    assert summarize(plan_text(got))["ArrowEvalPython"] == 1
    assert [(r.k, r.lcs, r.f) for r in got.orderBy("k").collect()] == [(1, 2, 1.0), (2, 0, 0.0), (3, 0, 0.0)]
