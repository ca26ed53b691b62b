import zlib

import numpy as np
import pytest

from evalspark.llm import quality
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op8_quality_classifier(spark, SF).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97


def junk(i):
    return " | ".join(w + "***" for w in words(i, 40))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark, awkward):
    more = spark.createDataFrame([(1000 + i, junk(i) if i % 2 else " ".join(words(i, 40)), None, None, None) for i in range(80)],
                                 awkward.schema)
    labels = labelled(spark, [(1000 + i, i % 2 ^ 1, None) for i in range(80)] + [(None, 1, None), (1000, 1, 1), (1, None, 0), (5, 1, 0), (5, 0, 0), (9999, 1, 1)])
    got = quality.classified(awkward.unionByName(more), labels).toPandas()
    assert len(got) == awkward.count() + 80 and got.score.between(0, 1).all()
    late = got[got.doc_id >= 1000]
    assert ((late.doc_id % 2 == 0) == (late.predicted == 1)).mean() > 0.9
    empty = got[got.text.isna() | (got.text.fillna("").str.strip() == "")]
    assert empty.score.nunique() == 1


@pytest.mark.parametrize("labels", [[], [(7, None, None)], [(7, 1, 0)], [(7, 1, 0), (8, 1, 0)]])
def test_few_or_no_labels(spark, awkward, labels):
    got = quality.classified(awkward, labelled(spark, labels))
    assert got.count() == awkward.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_empty_table(spark, nothing):
    assert quality.classified(nothing, labelled(spark, [(1, 1, 0)])).collect() == []


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 4, 0.25)], "doc_id long, text string, quality int, score double")
    got = quality.classified(rows, labelled(spark, [(1, 1, 0)])).first()
    assert got["quality"] == 4 and got["score"] != 0.25


def test_word_stream_marks():
    codes, text = quality.word_codes([b"Plain PLAIN plain 12", None, b"ok!!", b""])
    assert text.tolist() == [0] * 8 + [2, 2][: len(text) - 8] or set(text.tolist()) == {0, 2}
    marks = [c for c in codes.tolist() if c < 8]
    assert marks == [1, 6, 4, 3]  # Capitalised; CAPITALS again; again; number


def test_temperature_of_overconfident_logits():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    honest = np.where(y == 1, 1.0, -1.0) + rng.normal(0, 1.4, 4000)
    t = quality.fit_temperature(np.stack([np.zeros(4000), 5 * honest], 1), y)
    u = quality.fit_temperature(np.stack([np.zeros(4000), honest], 1), y)
    assert abs(t / u - 5) < 0.05
