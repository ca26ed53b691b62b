import zlib

from evalspark.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = language.op5_language_id(spark, SF).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def corpus(spark, awkward):
    samples = {"en": "the house and the garden with water", "de": "das Haus und der Garten mit Wasser",
               "xx": "zzq qzz zqz qqz zzz qqq"}
    rows = [(1000 + i, f"{t} {i}", lang, None, None) for i in range(30) for lang, t in samples.items()]
    rows += [(2000, "ohne Sprache", None, None, None)]
    return awkward.unionByName(spark.createDataFrame(rows, awkward.schema))


def test_awkward_rows(spark, awkward):
    docs = corpus(spark, awkward)
    got = language.predict(docs, language.fit(docs)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    none = got[[language.letters(t if isinstance(t, str) else None).size == 0 for t in got.text]]
    assert (none.lang_pred == "und").all() and (none.score == 1).all() and len(none) >= 5
    assert set(got.lang_pred) <= {"en", "de", "xx", "und"}
    late = got[(got.doc_id >= 1000) & (got.doc_id < 2000)]
    assert (late.lang_pred == late.lang).mean() > 0.95


def test_no_training_rows(spark, awkward, nothing):
    assert language.fit(nothing) is None and language.fit(awkward.where("lang IS NULL")) is None
    got = language.predict(awkward, None).toPandas()
    assert set(got.lang_pred) == {"und"} and set(got.score) == {0.0}


def test_empty_table_and_clashing_columns(spark, awkward, nothing):
    model = language.fit(corpus(spark, awkward))
    assert language.predict(nothing, model).collect() == []
    rows = spark.createDataFrame([(1, "the garden", "old", 7.0)], "doc_id long, text string, lang_pred string, score double")
    got = language.predict(rows, model).first()
    assert got["lang_pred"] == "en" and got["score"] <= 1


def test_weights_are_sparse(spark, awkward):
    model = language.fit(corpus(spark, awkward))
    assert 0 < (model.w != 0).mean() < 0.2
