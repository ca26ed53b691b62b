import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import substrings
from tests.llm.conftest import brute_removal, sha, texts_of


def test_query_equals_brute_force(spark, sf):
    want = brute_removal(texts_of(spark.read.parquet(f"{sf}/documents.parquet")))
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.op6_substring_dedup(spark, sf).collect()}
    assert got == {i: (n, cut, sha(kept)) for i, (n, cut, kept) in want.items()}
    assert any(cut for _, cut, _ in want.values())


@pytest.mark.parametrize("options", [{}, {"group_rows": 1}, {"window": 12, "prefix": 4}, {"window": 5, "prefix": 5, "group_rows": 3}])
def test_awkward_rows(awkward, options):
    rows = texts_of(awkward)
    want = brute_removal([r for r in rows if r[0] is not None], options.get("window", 50))
    got = substrings.remove_repeats(awkward, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_words"], r["n_removed"]) == (5, 0)
        else:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]], r["doc_id"]


def test_empty_table(nothing):
    assert substrings.removal(nothing).collect() == []


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text, 9, "s"), (2, text, 9, "t")], "doc_id long, text string, n_words int, spans string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["spans"]) for r in substrings.remove_repeats(rows).collect()}
    assert got == {1: (60, 0, "s"), 2: (60, 60, "t")}


def test_many_documents_around_one_passage(spark):
    passage = [f"p{i}" for i in range(55)]
    rows = [(i, " ".join([f"a{i}-{k}" for k in range(i % 7)] + passage + [f"b{i}-{k}" for k in range(i % 5)])) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removal(rows)
    for options in ({}, {"group_rows": 5}):
        got = substrings.remove_repeats(frame, **options).withColumn("h", F.sha2("kept_text", 256)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["h"]) for r in got} == {
            i: (n, cut, sha(kept)) for i, (n, cut, kept) in want.items()}


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_trees_give_maximal_repeats(seed):
    """Runs of a forest against all pairs of suffixes: no run is inside another, and each is the longest repeat of its place."""
    rng, window = np.random.default_rng(seed), 4
    rows, texts = [], []
    for i in range(40):
        n = int(rng.integers(1, 12))
        words = rng.integers(0, 2 + seed, n + window - 1).astype(np.uint64)
        doc, base = int(rng.integers(0, 9)), int(rng.integers(0, 3))
        rows.append((7, 7, i, doc, base, n, words.tobytes()))
        texts.append((doc, base, words.tolist()))
    want = set()
    for i, (doc, base, words) in enumerate(texts):
        longest = [max((common(words[o:], other[k:]) for d, _, other in texts if d < doc for k in range(len(other))), default=0)
                   for o in range(len(words) - window + 1)]
        want |= {(7, i, base + o, n - window + 1) for o, n in enumerate(longest)
                 if n >= window and not (o and longest[o - 1] == n + 1)}
    got = list(zip(*substrings._forest(rows, window).to_pydict().values(), strict=True))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_prefixes_are_lengthened_until_groups_fit(spark):
    """One word's long runs, and passages that start alike, with groups of one to a few stretches."""
    rows = [(i, " ".join(["w"] * (40 + i % 5 * 20) + [f"p{k % (3 + i % 4)}" for k in range(80)] + ["w"] * (i % 3 * 30))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removal(rows)
    for options in ({"group_rows": 1}, {"group_rows": 4}, {}):
        got = substrings.remove_repeats(frame, **options).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
