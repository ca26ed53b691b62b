import pytest
from pyspark.sql import functions as F

from evalspark.llm import decontaminate as d
from tests.llm.conftest import brute_hits, sha, texts_of, words


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_query_equals_brute_force(spark, sf):
    docs = texts_of(spark.read.parquet(f"{sf}/documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i: (n, hit, len(found), sha(",".join(found)), hit > 0) for i, (n, hit, found) in brute_hits(docs, items).items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in d.op3_decontamination(spark, sf).collect()}
    assert got == want and any(v[4] for v in want.values())


@pytest.mark.parametrize("options", [{}, {"block_words": 60, "segment_words": 300}])
def test_awkward_rows(spark, awkward, options):
    items = [(1, " ".join(words(2, 70)[5:30])), (2, "A, b-C!"), (3, None), (4, ""), (5, " ".join(words(7, 30_000)[28_995:29_015])),
             (6, "THE the The the the the the the the the"), (6, "x y x y x y x y x y"), (7, "日本語"), (None, "nbsp"),
             (10, "no id here at all"), (11, "zq zq zq")]
    rows = [(-1 if i is None else i, t) for i, t in texts_of(awkward)]
    want = brute_hits(rows, [(i, t) for i, t in items if i is not None])
    found = d.find(awkward, items_frame(spark, [x for x in items if x[0] is not None]), **options)
    got = found.withColumn("hit", d.covered("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = want[-1 if r["doc_id"] is None else r["doc_id"]]
        assert (r["n_words"], r["hit"], r["items"]) == (n, hit, names), r["doc_id"]


def test_null_item_ids_count_as_no_name(spark, awkward):
    d.find(awkward, items_frame(spark, [(None, "w1 w2"), (3, "a b c")])).collect()


def test_empty_tables(spark, awkward, nothing):
    items = items_frame(spark, [(1, "a b c")])
    assert d.contamination(nothing, items).collect() == []
    none = d.contamination(awkward, items_frame(spark, []))
    assert none.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and none.count() == awkward.count()


def test_proximity_allows_words_between(spark):
    docs = spark.createDataFrame([(1, "one two extra three four"), (2, "one two three four"), (3, "four three two one")],
                                 "doc_id long, text string")
    items = items_frame(spark, [(9, "one two three four")])
    exact = {r["doc_id"] for r in d.find(docs, items).where(F.size("spans") > 0).collect()}
    near = {r["doc_id"] for r in d.find(docs, items, slop=1).where(F.size("spans") > 0).collect()}
    assert exact == {2} and near == {1, 2}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "s")], "doc_id long, text string, segment int, n_words string")
    items = spark.createDataFrame([(1, "a b c", 3)], "item_id long, text string, doc_id int")
    assert d.contamination(docs, items).first()["contaminated"]
