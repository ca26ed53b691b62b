"""Golden tests: the published benchmark matrix, significance table and scenario report,
typed in as literal values, recomputed with our operators."""

import math

import pytest
from pyspark.sql import functions as F

from evalspark.operators import decision as D
from evalspark.operators import stats as T
from evalspark.operators.economics import slm_cost_per_1m, throughput
from evalspark.schemas import MATRIX_SCHEMA

INF = math.inf
# model, task, method, accuracy, latency_ms, cost_per_1m_tokens, privacy_risk, roi_breakeven_tokens
MATRIX = [
    ("gpt-4o", "code_generation", "API", 0.52, 1517.6, 10.0, "high", None),
    ("claude-haiku-4-5", "code_generation", "API", 0.54, 1663.56, 3.0, "high", None),
    ("gemini-2.5-flash", "code_generation", "API", 0.78, 1167.5, 1.4, "high", None),
    ("gpt-4o", "financial_sentiment", "API", 0.99, 660.64, 10.0, "high", None),
    ("claude-haiku-4-5", "financial_sentiment", "API", 0.93, 814.94, 3.0, "high", None),
    ("gemini-2.5-flash", "financial_sentiment", "API", 0.99, 482.81, 1.4, "high", None),
    ("gpt-4o", "summarization", "API", 0.22077699999999997, 1456.96, 10.0, "high", None),
    ("claude-haiku-4-5", "summarization", "API", 0.21251, 1881.1, 3.0, "high", None),
    ("gemini-2.5-flash", "summarization", "API", 0.219167, 1037.76, 1.4, "high", None),
    ("gpt-4o", "ner", "API", 0.882714, 852.28, 10.0, "high", None),
    ("claude-haiku-4-5", "ner", "API", 0.9073650000000001, 1079.51, 3.0, "high", None),
    ("gemini-2.5-flash", "ner", "API", 0.923142, 722.23, 1.4, "high", None),
    ("gpt-4o", "classification", "API", 0.85, 777.98, 10.0, "high", None),
    ("claude-haiku-4-5", "classification", "API", 0.81, 900.58, 3.0, "high", None),
    ("gemini-2.5-flash", "classification", "API", 0.85, 617.85, 1.4, "high", None),
    ("Llama-3.2-3B-Instruct", "code_generation", "LoRA", 0.3341, 5768.99, 15.6494, "low", INF),
    ("Mistral-7B-v0.3", "code_generation", "QLoRA", 0.0006, 4530.61, 12.2901, "low", INF),
    ("phi-4-mini-instruct", "code_generation", "LoRA", 0.4287, 2200.08, 5.9681, "low", 7437.0),
    ("Llama-3.2-3B-Instruct", "financial_sentiment", "LoRA", 0.76, 468.38, 10.1645, "low", INF),
    ("Llama-3.2-3B-Instruct", "summarization", "LoRA", 0.186, 1761.31, 9.5557, "low", 1161415.0),
    ("Llama-3.2-3B-Instruct", "ner", "LoRA", 0.7917, 940.42, 10.2042, "low", INF),
    ("Llama-3.2-3B-Instruct", "classification", "LoRA", 0.82, 459.5, 9.9718, "low", 17998915.0),
    ("Mistral-7B-v0.3", "financial_sentiment", "QLoRA", 0.845, 562.16, 12.1997, "low", INF),
    ("Mistral-7B-v0.3", "summarization", "QLoRA", 0.1715, 2247.67, 12.1944, "low", INF),
    ("Mistral-7B-v0.3", "ner", "QLoRA", 0.6267, 1102.48, 11.9627, "low", INF),
    ("Mistral-7B-v0.3", "classification", "QLoRA", 0.69, 555.93, 12.0645, "low", INF),
    ("phi-4-mini-instruct", "financial_sentiment", "LoRA", 0.545, 522.42, 11.3372, "low", INF),
    ("phi-4-mini-instruct", "summarization", "LoRA", 0.2245, 2318.26, 12.5774, "low", INF),
    ("phi-4-mini-instruct", "ner", "LoRA", 0.9328, 608.17, 6.5991, "low", 119027.0),
    ("phi-4-mini-instruct", "classification", "LoRA", 0.92, 161.77, 3.5106, "low", 59495.0),
]

# slm, llm, mean_difference, t, p, significant
SIGNIFICANCE = [
    ("phi-4-mini-instruct", "gpt-4o", -0.0825, -0.8702, 0.4333, False),
    ("phi-4-mini-instruct", "claude-haiku-4-5", -0.0698, -0.808, 0.4644, False),
    ("phi-4-mini-instruct", "gemini-2.5-flash", -0.1423, -1.3405, 0.2512, False),
    ("Mistral-7B-v0.3", "gpt-4o", -0.2259, -2.8118, 0.0482, True),
    ("Mistral-7B-v0.3", "claude-haiku-4-5", -0.2132, -2.3423, 0.0792, False),
    ("Mistral-7B-v0.3", "gemini-2.5-flash", -0.2857, -2.2039, 0.0923, False),
    ("Llama-3.2-3B-Instruct", "gpt-4o", -0.1143, -2.837, 0.047, True),
    ("Llama-3.2-3B-Instruct", "claude-haiku-4-5", -0.1016, -2.4701, 0.0689, False),
    ("Llama-3.2-3B-Instruct", "gemini-2.5-flash", -0.1741, -2.2528, 0.0874, False),
]

# task, volume, min_accuracy, privacy -> model, method, accuracy (4 dp), cost (2 dp), eligible
SCENARIOS = [
    ("s01", "classification", 10000000, 0.80, False, "gemini-2.5-flash", "API", 0.85, 14.0, 5),
    ("s02", "ner", 5000000, 0.75, True, "phi-4-mini-instruct", "LoRA", 0.9328, 33.0, 2),
    ("s03", "summarization", 50000000, 0.20, False, "gemini-2.5-flash", "API", 0.2192, 70.0, 4),
    ("s04", "financial_sentiment", 2000000, 0.80, True, "Mistral-7B-v0.3", "QLoRA", 0.845, 24.4, 1),
    ("s05", "code_generation", 1000000, 0.50, False, "gemini-2.5-flash", "API", 0.78, 1.4, 3),
    ("s06", "code_generation", 1000000, 0.30, True, "phi-4-mini-instruct", "LoRA", 0.4287, 5.97, 2),
    ("s07", "summarization", 5000000, 0.50, True, "NONE (no model meets constraints)", "-", None, None, 0),
    ("s08", "classification", 100000, 0.80, False, "gemini-2.5-flash", "API", 0.85, 0.14, 5),
    ("s09", "ner", 100000000, 0.85, False, "gemini-2.5-flash", "API", 0.9231, 140.0, 4),
    ("s10", "financial_sentiment", 20000000, 0.90, False, "gemini-2.5-flash", "API", 0.99, 28.0, 3),
]

BUDGET = {"classification": 32, "financial_sentiment": 32, "ner": 64, "summarization": 128, "code_generation": 256}


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame(MATRIX, MATRIX_SCHEMA).cache()


def test_scenario_report_matches_published(spark, matrix):
    sc = spark.createDataFrame([s[:5] for s in SCENARIOS], "scenario string, task string, monthly_volume long, "
                                                           "min_accuracy double, privacy_required boolean")
    got = {r.scenario: r for r in D.validation_report(matrix, sc).collect()}
    for s in SCENARIOS:
        r = got[s[0]]
        assert (r.recommended_model, r.recommended_method, r.n_eligible_candidates) == (s[5], s[6], s[9])
        if s[7] is None:
            assert r.accuracy is None and r.projected_monthly_cost_usd is None
        else:
            assert r.accuracy == pytest.approx(s[7]) and r.projected_monthly_cost_usd == pytest.approx(s[8])


def test_significance_matches_published(spark, matrix):
    scores = matrix.select("model", F.col("task").alias("unit"), F.col("accuracy").alias("score"))
    is_slm = F.col("model").isin("phi-4-mini-instruct", "Mistral-7B-v0.3", "Llama-3.2-3B-Instruct")
    got = {(r.slm, r.llm_baseline): r for r in T.paired_t(scores, is_slm).collect()}
    assert len(got) == 9
    for slm, llm, md, t, p, sig in SIGNIFICANCE:
        r = got[(slm, llm)]
        assert round(r.mean_difference, 4) == pytest.approx(md)
        assert round(r.t_statistic, 4) == pytest.approx(t)
        assert round(r.p_value, 4) == pytest.approx(p, abs=1e-4)
        assert r.significant_at_0_05 == sig
        assert r.n_pairs == 5


def test_slm_costs_reproduce_from_latency(spark, matrix):
    slm = matrix.filter(F.col("method") != "API")
    got = slm.select("cost_per_1m_tokens",
                     slm_cost_per_1m(throughput("latency_ms", task="task", budgets=BUDGET)).alias("c")).collect()
    assert len(got) == 15
    for r in got:
        assert r.c == pytest.approx(r.cost_per_1m_tokens, abs=1e-4)


def test_p_value_from_published_t():
    for _, _, _, t, p, _ in SIGNIFICANCE:
        assert round(T.t_two_sided_p(t, 4.0), 4) == pytest.approx(p, abs=1.5e-4)
