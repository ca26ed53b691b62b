"""Literal edge tables (FIXTURES.md part C), one assertion per documented rule."""

import math

import pytest
from pyspark.sql import functions as F

from evalspark.functions.entities import bio_spans, entity_set, parse_entities
from evalspark.functions.labels import match_label
from evalspark.functions.text import clean_code, cut_at_stop, token_set
from evalspark.operators import decision as D
from evalspark.operators import matrix as B
from evalspark.operators import metrics as M
from evalspark.operators.economics import roi_breakeven
from evalspark.sources.results_csv import read_results_csv


def test_latest_run_tie_broken_by_run_id(spark):
    df = spark.createDataFrame(
        [(2, "2024-01-01 00:00:00", "m", "t", 0.2), (1, "2024-01-01 00:00:00", "m", "t", 0.1),
         (0, "2023-01-01 00:00:00", "m", "t", 0.0)],
        "run_id long, start_time string, model string, task string, accuracy double",
    ).withColumn("start_time", F.to_timestamp("start_time"))
    for method in ("min_by", "window"):
        r = B.latest(df, ["model", "task"], method=method).collect()
        assert len(r) == 1 and r[0]["run_id"] == 1, method


def test_bio_spans_orphan_i_and_type_not_compared(spark):
    # I-PER, B-PER, I-ORG, O, B-LOC
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], [2, 1, 4, 0, 5])], "tokens array<string>, tags array<int>")
    spans = df.select(F.explode(bio_spans("tokens", "tags")).alias("s")).select("s.*").collect()
    assert [(s.type_id, s.pos, s.surface) for s in spans] == [(0, 1, "b c"), (2, 4, "e")]


def test_bio_spans_all_o_and_empty(spark):
    df = spark.createDataFrame([(["a", "b"], [0, 0]), ([], [])], "tokens array<string>, tags array<int>")
    assert [r.n for r in df.select(F.size(bio_spans("tokens", "tags")).alias("n")).collect()] == [0, 0]


@pytest.mark.parametrize("truth,pred,expect", [
    ([], [], (1.0, 1.0, 1.0)), ([], ["x"], (0.0, 0.0, 0.0)), (["x"], [], (0.0, 0.0, 0.0)),
    (["x", "y"], ["x"], (1.0, 0.5, 2 / 3)),
])
def test_entity_prf(spark, truth, pred, expect):
    df = spark.createDataFrame([(truth, pred)], "t array<string>, p array<string>")
    r = M.entity_prf_scores(df, "t", "p").collect()[0]
    assert (r.precision, r.recall) == pytest.approx(expect[:2]) and r.f1 == pytest.approx(expect[2])


def test_token_f1_skips_empty_truth_and_zero_precision_for_empty_pred(spark):
    df = spark.createDataFrame([("", "a b"), ("a b", ""), ("A b", "a c")], "t string, p string")
    r = M.token_f1_scores(df, token_set("t"), token_set("p"), keep=["t"], drop_empty=False).collect()
    assert r[0].f1 is None and r[0].precision is None
    assert (r[1].precision, r[1].f1) == (0.0, 0.0)
    assert r[2].f1 == pytest.approx(0.5)
    assert M.token_f1_scores(df, token_set("t"), token_set("p")).count() == 2


@pytest.mark.parametrize("n,c,k,expect", [(10, 0, 10, 0.0), (10, 1, 10, 1.0), (10, 3, 1, 0.3),
                                          (10, 3, 2, 1 - (7 / 10) * (6 / 9)), (3, 0, 10, None)])
def test_pass_at_k(spark, n, c, k, expect):
    v = spark.range(1).select(M.pass_at_k_expr(F.lit(n), F.lit(c), F.lit(k)).alias("v")).collect()[0]["v"]
    assert (v is None) if expect is None else v == pytest.approx(expect)


@pytest.mark.parametrize("text,expect", [("\nclass A", ""), ("def f():\n  return 1", "def f():\n  return 1"),
                                         ("x\nprint(1)\ndef g", "x"), ("x\n#c\nclass B", "x")])
def test_cut_at_stop(spark, text, expect):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cut_at_stop("t").alias("v")).collect()[0]["v"] == expect


def test_clean_code(spark):
    df = spark.createDataFrame([("```python\nreturn 1\n```", "import x\ndef f(a):\n  '''doc'''"),
                                ("def g():\n  pass", "def f():"), ("return 2", "no signature")],
                               "raw string, prompt string")
    got = [r.v for r in df.select(clean_code("raw", "prompt").alias("v")).collect()]
    assert got == ["def f(a):\nreturn 1", "def g():\n  pass", "return 2"]


@pytest.mark.parametrize("cost,api,slm,expect", [(100.0, 10.0, 10.0, math.inf), (100.0, 10.0, 12.0, math.inf),
                                                 (0.0, 10.0, 5.0, 0.0), (5.0, 10.0, 5.0, 1_000_000.0)])
def test_roi(spark, cost, api, slm, expect):
    v = spark.range(1).select(roi_breakeven(F.lit(cost), F.lit(api), F.lit(slm)).alias("v")).collect()[0]["v"]
    assert v == expect


def test_label_match_order_and_default(spark):
    df = spark.createDataFrame([("GOOD and bad",), ("none",), ("good!",)], "p string")
    got = [r.v for r in df.select(match_label("p", ["bad", "good"]).alias("v")).collect()]
    assert got == ["bad", "bad", "good"]
    got_none = [r.v for r in df.select(match_label("p", ["bad", "good"], default=None).alias("v")).collect()]
    assert got_none == ["bad", None, "good"]


def test_csv_inf_blank_and_number(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("model,task,method,accuracy,latency_ms,cost_per_1m_tokens,privacy_risk,roi_breakeven_tokens\n"
                 "a,t,API,0.5,1.0,10.0,high,inf\nb,t,LoRA,0.6,1.0,3.0,low,\nc,t,LoRA,0.7,1.0,2.0,low,1.5\n")
    got = {r.model: r.roi_breakeven_tokens for r in read_results_csv(spark, str(p)).collect()}
    assert got == {"a": math.inf, "b": None, "c": 1.5}


def test_null_and_nan_accuracy_never_eligible_and_last_in_fallback(spark):
    m = spark.createDataFrame(
        [("x", "t", "API", None, 1.0, 1.0, "high", None), ("y", "t", "API", float("nan"), 1.0, 1.0, "high", None),
         ("z", "t", "API", 0.1, 1.0, 1.0, "high", None), ("w", "t", "API", 0.2, 1.0, 1.0, "high", None)],
        "model string, task string, method string, accuracy double, latency_ms double, cost_per_1m_tokens double, "
        "privacy_risk string, roi_breakeven_tokens double")
    sc = spark.createDataFrame([("s", "t", 1000, 0.5, False)],
                               "scenario string, task string, monthly_volume long, min_accuracy double, "
                               "privacy_required boolean")
    assert D.recommend(m, sc).count() == 0
    fb = [r.model for r in D.fallback(m, sc).orderBy("rank").collect()]
    assert fb == ["w", "z", "x"] or fb == ["w", "z", "y"]
    assert fb[:2] == ["w", "z"]


def test_parse_entities(spark):
    df = spark.createDataFrame([('```json\n{"PER": ["Ann ", "bob"], "LOC": ["Rome"]}\n```',), ('{"PER": ["a"',),
                                ('{"PER": "notalist"}',), ("{}",)], "r string")
    got = [sorted(r.v) for r in df.select(parse_entities("r").alias("v")).collect()]
    assert got == [["ann", "bob", "rome"], [], [], []]


def test_entity_set_flattens_map(spark):
    df = spark.createDataFrame([({"PER": [" Ann", "ann"], "ORG": ["X"]},)], "m map<string,array<string>>")
    assert sorted(df.select(entity_set("m").alias("v")).collect()[0]["v"]) == ["ann", "x"]
