"""Inputs that real logs and models produce: text run ids, missing tags, wrong reply counts,
no-break spaces, malformed answers, log generations, and results that no partitioning changes."""

import pytest
from pyspark.sql import functions as F

from evalspark.functions.entities import parse_entities
from evalspark.functions.porter import stem
from evalspark.functions.text import strip_ws, token_set
from evalspark.operators import matrix as B
from evalspark.operators import metrics as M
from evalspark.operators import scoring as I
from evalspark.operators import stats as T
from evalspark.plans.catalog import QUERIES
from evalspark.schemas import RUN_SCHEMA
from evalspark.sources import datasets as S3
from evalspark.sources import prediction_logs as PL

# Words and their stems under the extended rules, worked by hand.
EXTENDED_STEMS = [("skies", "sky"), ("dying", "die"), ("news", "news"), ("innings", "inning"), ("proceed", "proceed"),
                  ("days", "day"), ("enjoy", "enjoy"), ("ties", "tie"), ("died", "die"), ("cried", "cri"), ("spied", "spi"),
                  ("flies", "fli"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("possibly", "possibl"),
                  ("geology", "geolog"), ("hopefully", "hope"), ("totally", "total"), ("aging", "age"), ("falling", "fall")]


@pytest.mark.parametrize(("word", "expect"), EXTENDED_STEMS)
def test_extended_stems(word, expect):
    assert stem(word) == expect


def _runs(spark):
    from datetime import datetime

    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    bench = {"phase": "phase2_benchmark"}
    rows = [("ffe1", "e", late, {"model": "o/m", "task": "t", **bench}, {}, {"accuracy": 0.1}),
            ("0a2b", "e", late, {"model": "o/m", "task": "t", **bench}, {}, {"accuracy": 0.2}),
            ("zz", "e", early, {"model": "o/m", "task": "t", **bench}, {}, {"accuracy": 0.3}),
            ("c3", "e", None, {"model": "o/m", "task": "t", **bench}, {}, {"accuracy": 0.4}),
            ("d4", "e", early, bench, {}, {"accuracy": 0.5})]
    return spark.createDataFrame(rows, RUN_SCHEMA)


@pytest.mark.parametrize("method", ["min_by", "window"])
def test_text_run_ids_and_missing_tags(spark, method):
    got = {(r.model, r.task): (r.run_id, r.accuracy) for r in B.latest_benchmark(_runs(spark), method=method).collect()}
    assert got == {("o/m", "t"): ("0a2b", 0.2), ("unknown", "unknown"): ("d4", 0.5)}
    matrix = B.compile_matrix(_runs(spark), None, {}, method=method).collect()
    assert {(r.model, r.task) for r in matrix} == {("m", "t"), ("unknown", "unknown")}


def test_first_maximum_with_text_sample_ids(spark):
    df = spark.createDataFrame([("m", "b/2", 3.0), ("m", "a/1", 3.0), ("m", "c", 1.0), ("m", "0", None)],
                               "model string, sample_id string, latency_s double")
    assert M.latency_profile(df).first()["max_latency_sample"] == "a/1"


@pytest.mark.parametrize("batch_mode", [True, False])
def test_reply_counts_are_checked(spark, batch_mode):
    def one_too_many():
        return lambda prompts: ["x"] * (len(prompts) + 1)

    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id int, prompt string")
    got = I.score(df, one_too_many, batch_mode=batch_mode, max_attempts=1).collect()
    assert {(r.status, r.prediction, r.batch_size, r.error) for r in got} == {
        ("error", "error", 1, "ValueError: 2 replies to 1 prompt")}


def test_error_texts_are_kept_whole(spark):
    def failing():
        def predict(prompts):
            raise RuntimeError("x" * 5000)
        return predict

    df = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert len(I.score(df, failing, max_attempts=1).first()["error"]) == len("RuntimeError: ") + 5000


def test_white_space_is_pythons(spark):
    texts = [" a b\u0085", " x　", "\x1cq\x1f", "​z", " plain \n", "two words"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strip_ws("t").alias("s"), token_set("t").alias("k")).collect()
    assert [r.s for r in got] == [t.strip() for t in texts]
    assert [sorted(r.k) for r in got] == [sorted(set(t.lower().split())) for t in texts]


ANSWERS = [('{"PER": ["Ann", "Bob "]}', {"ann", "bob"}), ('{"PER": [1, "Bob"]}', set()), ('{"PER": ["Ann", null]}', set()),
           ('{"PER": ["Ann"]} trailing', set()), ('{"PER": null}', set()), ('["Ann"]', set()), ("", set()), ("{", set()),
           ('```json\n{"LOC": ["X"], "else": [1]}\n```', {"x"}), ('{"ORG": []}', set()), ('{"PER": 5}', set()),
           ('{"MISC": ["caf\\u00e9 \\"q\\""]}', {'café "q"'})]


@pytest.mark.parametrize(("answer", "expect"), ANSWERS)
def test_entity_answers(spark, answer, expect):
    df = spark.createDataFrame([(answer,)], "r string")
    assert set(df.select(parse_entities("r").alias("e")).first()["e"]) == expect


def test_log_generations_in_one_folder(spark, tmp_path):
    (tmp_path / "old.csv").write_text("sample_id,true_label,m_pred,m_latency\n1,a,a,0.5\n2,b,x,0.7\n")
    (tmp_path / "new.csv").write_text('sample_id,true_label,m_pred,m_correct,m_latency_s\n3,a,"two\nlines",1,0.9\n')
    long = PL.wide_to_long_predictions(PL.read_wide_log(spark, str(tmp_path)), {"m": "model"})
    got = {(r.sample_id, r.prediction, r.latency_s, r.correct) for r in long.collect()}
    assert got == {("1", "a", 0.5, None), ("2", "x", 0.7, None), ("3", "two\nlines", 0.9, 1)}


@pytest.mark.parametrize(("partitions", "adaptive"), [("4", "true"), ("8", "false"), ("200", "false")])
def test_scorecards_do_not_depend_on_partitions(spark, sf, partitions, adaptive):
    from tests.test_oracle import ORACLE, TABLES, fingerprint

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = QUERIES["m17_multitask_scorecard"](spark, sf)
        rows = [tuple(r) for r in df.collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    cur = con.execute(ORACLE["m17_multitask_scorecard"])
    want = cur.fetchall()
    assert fingerprint(rows, df.columns) == fingerprint(want, [d[0] for d in cur.description])


def test_many_models_are_one_small_plan(spark):
    rows = [(f"m{m:03d}", u, float((m * 7 + u * 13) % 17)) for m in range(60) for u in range(20)]
    scores = spark.createDataFrame(rows, "model string, unit int, score double")
    got = T.paired_t(scores, F.col("model") < "m030")
    assert got.count() == 30 * 30
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_splits_are_disjoint_and_complete(spark, sf):
    storage = {"financial_sentiment": {"path": f"{sf}/documents.parquet", "input_col": "text", "label_col": "lang", "id_col": "doc_id"}}
    parts = [{r.doc_id for r in S3.load_task_dataset(spark, "financial_sentiment", storage, split)[0].collect()} for split in S3.SPLITS]
    every = {r.doc_id for r in S3.load_task_dataset(spark, "financial_sentiment", storage)[0].collect()}
    assert set.union(*parts) == every and sum(map(len, parts)) == len(every) and all(parts)
    with pytest.raises(ValueError, match="split"):
        S3.load_task_dataset(spark, "financial_sentiment", storage, "dev")
    with pytest.raises(S3.UnknownTask):
        S3.load_task_dataset(spark, "nothing", storage)
    with pytest.raises(ValueError, match="storage"):
        S3.load_task_dataset(spark, "ner", storage)
