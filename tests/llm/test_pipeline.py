import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from evalspark.llm.common import scratch
from tests.llm.conftest import brute_components, brute_hits, brute_removal, texts_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned over a small table, and what it was given."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        found = scratch(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, found)
        docs = found
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "substrings", "decontaminate", "tokens"]
    for name, (given, found) in stages.items():
        if name != "tokens":
            assert found.columns == given.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_the_good(spark, stages):
    given, found = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = labels.join(found, "doc_id", "left_semi").groupBy("quality").count().collect()
    kept, all_of = {r["quality"]: r["count"] for r in kept}, {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert kept[1] > 0.97 * all_of[1] and kept.get(0, 0) < 0.05 * all_of[0]


def test_near_duplicates(stages):
    given, found = stages["near_duplicates"]
    want = {i for i, (_, c) in brute_components(texts_of(given)).items() if c == i}
    assert {i for i, _ in texts_of(found)} == want and found.count() == len(want) < given.count()


def test_substrings(stages):
    given, found = stages["substrings"]
    texts, want = dict(texts_of(given)), brute_removal(texts_of(given))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in found.collect()}
    assert got.keys() == texts.keys()
    for i, (_, cut, kept) in want.items():
        assert got[i][0] == (kept if cut else texts[i]) and (not cut or got[i][1] == len(kept))


def test_decontamination(spark, stages):
    given, found = stages["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, (_, hit, _) in brute_hits(texts_of(given), items).items() if not hit}
    assert {i for i, _ in texts_of(found)} == want and len(want) < given.count()


def test_tokens(stages):
    given, found = stages["tokens"]
    assert found.count() == given.count()
    both = found.join(given, "doc_id").where(F.sha2("text", 256) != F.col("decoded_sha256"))
    assert both.count() == 0


def test_run_equals_the_stages(spark, stages):
    want = sorted(tuple(r) for r in stages["tokens"][1].collect())
    assert sorted(tuple(r) for r in cp.run(spark, SF).collect()) == want


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_awkward_and_empty_rows(spark, awkward, nothing, name):
    stage = dict(cp.STAGES)[name]
    wide = awkward.withColumn("score", F.lit(1)).withColumn("spans", F.lit("s")).withColumn("n_words", F.lit(2))
    for docs in (awkward, wide):
        found = stage(spark, docs, SF)
        assert found.count() <= docs.count()
        if name != "tokens":
            assert found.columns == docs.columns
            assert found.where("doc_id IS NULL").count() == 1 or name == "quality"
    assert stage(spark, nothing, SF).collect() == []
