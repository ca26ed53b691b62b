"""Repeated ids, NULL names, wide slop, and vectors of several lengths."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import decontaminate, language, neighbours, quality
from tests.llm.conftest import words
from tests.llm.test_neighbours import brute, by_query


def test_an_item_without_a_name_is_found_beside_named_ones(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (3, "d e"), (None, "x y")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(docs, items).collect()}
    assert got[1]["items"] == ["3", None] and got[2]["items"] == [None]
    rows = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert (rows[1]["n_items"], rows[1]["n_hit"], rows[2]["contaminated"]) == (2, 4, True)


@pytest.mark.parametrize("slop", [0, 30, 70, 300])
def test_no_slop_reaches_over_into_the_next_document(spark, slop):
    docs = spark.createDataFrame([(1, "alpha x x x"), (2, "beta gamma")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    assert decontaminate.find(docs, items, slop=slop).where(F.size("spans") > 0).count() == 0


def test_which_text_of_a_repeated_id_stays_does_not_depend_on_the_order_of_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(5, " ".join(words(k, 30)), "en", f"s{k}", k) for k in range(6)] + [(7, "other words entirely", None, None, None)] * 2
    kept = {tuple(sorted(tuple(r) for r in corpus_pipeline.near_duplicate_stage(
        spark, spark.createDataFrame(part, schema).repartition(n), None).select("doc_id", "text", "source").collect()))
        for part, n in ((rows, 1), (rows[::-1], 3))}
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_rows_of_one_labelled_id_stay_within_the_sample(spark, monkeypatch):
    rows = [(1, " ".join(words(k, 20))) for k in range(300)] + [(2, "bad *** bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "Network", lambda x, y, held: seen.append(len(x)))
    quality.fit(docs, labels, sample=10)
    assert seen == [10]


def test_rows_of_one_language_id_stay_within_the_sample(spark, monkeypatch):
    rows = [(1, " ".join(words(k, 20)), "en") for k in range(200)] + [(2, "zwei drei", "de"), (3, "vier", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "Regression", lambda rows, label, languages, idf: seen.append(np.bincount(label).tolist()))
    language.fit(docs, per_language=20)
    assert seen == [[2, 20]]


def test_each_length_of_vectors_is_searched_by_itself(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=(3, 5, 8)[i % 3]).tolist()) for i in range(0, 240, 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = by_query(neighbours.nearest(frame, frame.where("vec_id % 100 = 0"), reach=1.0))
    for q, x in rows:
        if q % 100 == 0:
            same = [r for r in rows if len(r[1]) == len(x)]
            assert [i for _, i in got[q]] == [i for _, i in brute(same, [(q, x)])[q]]


def test_probing_touches_only_near_buckets():
    """Of random codes, a radius below the number of parts touches rows that share a part."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (20_000, 4))
    segment = neighbours.Segment.__new__(neighbours.Segment)
    segment.ids, segment.parts = np.arange(len(codes)), []
    for part in codes.T:
        order = np.argsort(part, kind="stable")
        values, starts = np.unique(part[order], return_index=True)
        segment.parts.append((values, np.append(starts, len(part)), order))
    touched = []
    rows = segment.codes.copy()
    assert (rows == codes).all()

    class Counting(np.ndarray):
        def __getitem__(self, at):
            touched.append(len(at))
            return np.asarray(self)[at]

    segment.__dict__["codes"] = rows.view(Counting)
    found = segment.probe(codes[5], 3)
    assert 5 in found and touched[0] < 50
