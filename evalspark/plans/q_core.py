"""Catalog section: predictions -> labels -> metrics -> economics -> matrix -> decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import fixtures as fx
from evalspark.functions.labels import exact_match, is_error, match_label
from evalspark.operators import decision as D
from evalspark.operators import matrix as B
from evalspark.operators import metrics as M
from evalspark.operators.economics import roi_breakeven, slm_cost_per_1m, throughput, training_cost
from evalspark.oracle import exact_mean_sql, with_fixtures
from evalspark.plans.benchmark import fixture_matrix
from evalspark.plans.catalog import register, round_report
from evalspark.plans.scorecard import classification_scores, scorecard

LABELS = fx.PRED_LABELS  # label-map order for N1: ['bad', 'good']
WS = r"'^\s+|\s+$'"

# pred_label of N1, DuckDB formulation
_PL = "coalesce(list_filter(['bad', 'good'], lambda l: contains(lower(prediction), lower(l)))[1], 'bad')"


# ---------------------------------------------------------------- N1 / N2 / M1 / M2 / I5
@register("n1_label_match", with_fixtures(
    f"SELECT sample_id, model, {_PL} AS pred_label FROM predictions", "predictions"))
def n1_label_match(spark, sf):
    p = fx.predictions(spark, sf)
    return p.select("sample_id", "model", match_label("prediction", LABELS).alias("pred_label"))


@register("n2_exact_match", with_fixtures(
    f"""SELECT sample_id, model,
        cast(regexp_replace(prediction, {WS}, '', 'g') = true_label AS int) AS exact,
        cast(lower(regexp_replace(prediction, {WS}, '', 'g')) = lower(true_label) AS int) AS exact_lower
    FROM predictions""", "predictions"))
def n2_exact_match(spark, sf):
    p = fx.predictions(spark, sf)
    return p.select("sample_id", "model", exact_match("prediction", "true_label").alias("exact"),
                    exact_match("prediction", "true_label", lower=True).alias("exact_lower"))


@register("m1_accuracy", with_fixtures(
    f"""SELECT model, task, avg(CASE WHEN {_PL} = true_label THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM predictions GROUP BY model, task""", "predictions"))
def m1_accuracy(spark, sf):
    s = classification_scores(fx.predictions(spark, sf), LABELS)
    return M.accuracy(s, correct="score")


@register("m2_latency", with_fixtures(
    "SELECT model, task, round(avg(latency_s) * 1000, 6) AS latency_ms FROM predictions GROUP BY model, task",
    "predictions"))
def m2_latency(spark, sf):
    return round_report(M.mean_latency_ms(fx.predictions(spark, sf)), ["latency_ms"])


_ERR = "('error', 'Error', 'Unknown', 'unknown', '{}', '')"


@register("i5_error_sentinels", with_fixtures(
    f"""SELECT model, task,
        avg(CASE WHEN {_PL} = true_label THEN 1.0 ELSE 0.0 END) AS accuracy_wrong,
        avg(CASE WHEN prediction IN {_ERR} THEN NULL WHEN {_PL} = true_label THEN 1.0 ELSE 0.0 END) AS accuracy_exclude,
        sum(CASE WHEN prediction IN {_ERR} THEN 1 ELSE 0 END)::bigint AS n_errors
    FROM predictions GROUP BY model, task""", "predictions"))
def i5_error_sentinels(spark, sf):
    s = classification_scores(fx.predictions(spark, sf), LABELS)
    c = F.col("score")
    excl = F.when(is_error("prediction"), F.lit(None).cast("double")).otherwise(c)
    return s.groupBy("model", "task").agg(
        F.avg(c).alias("accuracy_wrong"), F.avg(excl).alias("accuracy_exclude"),
        F.sum(is_error("prediction").cast("int")).cast("bigint").alias("n_errors"))


# ---------------------------------------------------------------- M8 / M9
@register("m8_latency_profile", with_fixtures(
    """SELECT model, round(avg(latency_s), 6) AS mean_latency, round(stddev_samp(latency_s), 6) AS std_latency,
        max(latency_s) AS max_latency, arg_max(sample_id, (latency_s, -sample_id)) AS max_latency_sample,
        min(latency_s) AS min_latency, count(*) AS n
    FROM predictions GROUP BY model""", "predictions"))
def m8_latency_profile(spark, sf):
    return round_report(M.latency_profile(fx.predictions(spark, sf)), ["mean_latency", "std_latency"])


@register("m9_latency_outliers", with_fixtures(
    "SELECT sample_id, model, latency_s, prediction FROM predictions WHERE latency_s > 10.0", "predictions"))
def m9_latency_outliers(spark, sf):
    return M.latency_outliers(fx.predictions(spark, sf)).select("sample_id", "model", "latency_s", "prediction")


# ---------------------------------------------------------------- M11-M14, M17 on predictions
_SC = [("g", f"""SELECT model, task, count(*) AS n_samples, {exact_mean_sql("s", 10 ** 9, 4)} AS accuracy,
        {exact_mean_sql("latency_s * 1000", 10 ** 3, 2)} AS latency_ms
    FROM (SELECT *, CASE WHEN {_PL} = true_label THEN 1.0::double ELSE 0.0::double END AS s FROM predictions) q
    GROUP BY model, task"""),
       ("t", "SELECT *, 32 / (latency_ms / 1000) AS tokens_per_second FROM g"),
       ("c", "SELECT *, round(2.5 / (tokens_per_second * 3600) * 1e6, 4) AS cost_per_1m_tokens FROM t")]


@register("m11_throughput", with_fixtures(
    "SELECT model, task, tokens_per_second FROM t", "predictions", extra=_SC))
def m11_throughput(spark, sf):
    return scorecard(classification_scores(fx.predictions(spark, sf), LABELS)) \
        .select("model", "task", "tokens_per_second")


@register("m12_slm_cost", with_fixtures(
    "SELECT model, task, cost_per_1m_tokens FROM c", "predictions", extra=_SC))
def m12_slm_cost(spark, sf):
    return scorecard(classification_scores(fx.predictions(spark, sf), LABELS)) \
        .select("model", "task", "cost_per_1m_tokens")


@register("m17_scorecard", with_fixtures(
    """SELECT model, task, n_samples, accuracy, latency_ms, tokens_per_second, cost_per_1m_tokens,
        'low' AS privacy_risk,
        CASE WHEN 10.0 - cost_per_1m_tokens <= 0 THEN 'inf'::double
             ELSE round(0.0 / (10.0 - cost_per_1m_tokens) * 1e6, 0) END AS roi_breakeven_tokens
    FROM c""", "predictions", extra=_SC))
def m17_scorecard(spark, sf):
    return scorecard(classification_scores(fx.predictions(spark, sf), LABELS))


# ---------------------------------------------------------------- run log -> matrix
_SHORT = "regexp_replace(model, '^.*/', '')"
_BENCH = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model, task
        ORDER BY start_time DESC, run_id) AS rn FROM runs
        WHERE phase IN ('phase2_benchmark', 'phase1_baseline')) q WHERE rn = 1"""
_TRAIN = f"""SELECT model_short, task, method, training_hours FROM (
        SELECT {_SHORT} AS model_short, task, coalesce(method, 'unknown') AS method,
               coalesce(training_hours, 0.0) AS training_hours,
               row_number() OVER (PARTITION BY {_SHORT}, task ORDER BY start_time DESC, run_id) AS rn
        FROM runs WHERE phase = 'phase2_fine_tuning') q WHERE rn = 1"""
_SLM = f"""SELECT regexp_replace(b.model, '^.*/', '') AS model, b.task,
        CASE WHEN t.method IS NOT NULL THEN t.method ELSE coalesce(b.method, 'API') END AS method,
        b.accuracy, b.latency_ms, b.cost_per_1m_tokens, coalesce(b.privacy_risk, 'unknown') AS privacy_risk,
        CASE WHEN t.method IS NULL THEN NULL
             WHEN b.cost_per_1m_tokens IS NULL THEN NULL
             WHEN 10.0 - b.cost_per_1m_tokens <= 0 THEN 'inf'::double
             ELSE round(t.training_hours * 2.5 / (10.0 - b.cost_per_1m_tokens) * 1e6, 0) END AS roi_breakeven_tokens
    FROM bench b LEFT JOIN train t ON t.model_short = regexp_replace(b.model, '^.*/', '') AND t.task = b.task"""
_WIDE = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY task
        ORDER BY start_time DESC, run_id) AS rn FROM runs) q WHERE rn = 1"""
_API = """SELECT p.model, w.task, 'API' AS method,
        CASE p.prefix WHEN 'a' THEN w.accuracy WHEN 'b' THEN w.accuracy / 2 END AS accuracy,
        CASE p.prefix WHEN 'a' THEN round(w.latency_ms / 1000 * 1000, 2) END AS latency_ms,
        p.price AS cost_per_1m_tokens, 'high' AS privacy_risk, CAST(NULL AS double) AS roi_breakeven_tokens
    FROM wide w CROSS JOIN (VALUES ('a', 'gpt-4o', 10.0::double), ('b', 'gemini-2.5-flash', 1.4::double))
         AS p(prefix, model, price)"""
MATRIX_CTES = [("bench", _BENCH), ("train", _TRAIN), ("slm", _SLM), ("wide", _WIDE), ("api", _API),
               ("matrix", "SELECT * FROM api UNION ALL SELECT * FROM slm")]


def matrix_sql(body: str, *more: str, extra=()) -> str:
    return with_fixtures(body, "runs", *more, extra=MATRIX_CTES + list(extra))


@register("b8_compile_matrix", matrix_sql("SELECT * FROM matrix"))
def b8_compile_matrix(spark, sf):
    return fixture_matrix(spark, sf)


@register("b3_latest_benchmark", with_fixtures(
    "SELECT run_id, model, task, start_time, accuracy FROM bench", "runs", extra=[("bench", _BENCH)]))
def b3_latest_benchmark(spark, sf):
    return B.latest_benchmark(fx.runs(spark, sf)).select("run_id", "model", "task", "start_time", "accuracy")


@register("b3_latest_benchmark_window", with_fixtures(
    "SELECT run_id, model, task, start_time, accuracy FROM bench", "runs", extra=[("bench", _BENCH)]))
def b3_latest_benchmark_window(spark, sf):
    return B.latest_benchmark(fx.runs(spark, sf), method="window") \
        .select("run_id", "model", "task", "start_time", "accuracy")


@register("b3_latest_per_store", with_fixtures(
    """SELECT store, run_id, model, task, start_time FROM (SELECT *, row_number() OVER (
        PARTITION BY store, model, task ORDER BY start_time DESC, run_id) AS rn FROM runs
        WHERE phase IN ('phase2_benchmark', 'phase1_baseline')) q WHERE rn = 1""", "runs"))
def b3_latest_per_store(spark, sf):
    return B.latest_benchmark(fx.runs(spark, sf), per_store=True) \
        .select("store", "run_id", "model", "task", "start_time")


@register("b4_training_info", with_fixtures("SELECT * FROM train", "runs", extra=[("train", _TRAIN)]))
def b4_training_info(spark, sf):
    return B.training_info(fx.runs(spark, sf))


@register("b5_enrich", matrix_sql("SELECT * FROM slm"))
def b5_enrich(spark, sf):
    r = fx.runs(spark, sf)
    return B.enrich(B.latest_benchmark(r), B.training_info(r))


@register("b2_latest_per_experiment", with_fixtures(
    "SELECT task AS experiment, run_id, start_time FROM wide", "runs", extra=[("wide", _WIDE)]))
def b2_latest_per_experiment(spark, sf):
    r = fx.runs_log(spark, sf)
    return B.latest(r, ["experiment"]).select("experiment", "run_id", "start_time")


@register("b1_wide_to_long", with_fixtures(
    """SELECT task, store, m.model,
       CASE m.model WHEN 'a' THEN accuracy WHEN 'b' THEN accuracy / 2 END AS accuracy,
       CASE m.model WHEN 'a' THEN latency_ms / 1000 END AS latency_s
    FROM (SELECT *, row_number() OVER (PARTITION BY task, store ORDER BY start_time DESC, run_id) AS rn FROM runs) q
    CROSS JOIN (VALUES ('a'), ('b'), ('c')) AS m(model)
    WHERE rn = 1 AND m.model <> 'c'""", "runs"))
def b1_wide_to_long(spark, sf):
    wide = fx.runs_wide(spark, sf, experiment_cols=("task", "store"))
    return B.wide_to_long(wide, {"a": "a", "b": "b", "c": "c"}, experiment_cols=("task", "store"))


@register("b6_union", matrix_sql("SELECT method, count(*) AS n FROM matrix GROUP BY method"))
def b6_union(spark, sf):
    return fixture_matrix(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


_TASKS = ["click", "error", "purchase", "signup", "view"]


@register("b7_accuracy_pivot", matrix_sql(
    "SELECT model, " + ", ".join(f"avg(CASE WHEN task = '{t}' THEN accuracy END) AS {t}" for t in _TASKS)
    + " FROM matrix GROUP BY model"))
def b7_accuracy_pivot(spark, sf):
    return B.accuracy_pivot(fixture_matrix(spark, sf), _TASKS)


_DECLARED_MODELS = ["gpt-4o", "gemini-2.5-flash", "claude-haiku-4-5"] + [f"m{i}" for i in range(7)]
_DECLARED_TASKS = _TASKS + ["train"]


def _values(xs):
    return ", ".join(f"('{x}')" for x in xs)


@register("b9_coverage", matrix_sql(
    f"""SELECT gm.model, gt.task FROM (VALUES {_values(_DECLARED_MODELS)}) AS gm(model),
        (VALUES {_values(_DECLARED_TASKS)}) AS gt(task)
        WHERE NOT EXISTS (SELECT 1 FROM matrix x WHERE x.model = gm.model AND x.task = gt.task)"""))
def b9_coverage(spark, sf):
    return B.missing_cells(fixture_matrix(spark, sf), _DECLARED_MODELS, _DECLARED_TASKS)


@register("n8_short_model", with_fixtures(
    f"SELECT run_id, {_SHORT} AS model_short FROM runs", "runs"))
def n8_short_model(spark, sf):
    return B.short_name(fx.runs(spark, sf)).select("run_id", "model_short")


@register("m13_training_cost", with_fixtures(
    "SELECT run_id, training_hours * 2.5 AS training_cost_usd FROM runs WHERE phase = 'phase2_fine_tuning'",
    "runs"))
def m13_training_cost(spark, sf):
    r = fx.runs(spark, sf).filter(F.col("phase") == "phase2_fine_tuning")
    # unrounded, as the matrix uses it; 2-decimal rounding is a report-edge option
    return r.select("run_id", training_cost("training_hours", decimals=None).alias("training_cost_usd"))


_BUDGETS = {"click": 32, "error": 64, "purchase": 128, "signup": 32, "view": 256}
_BUD_SQL = "CASE task " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _BUDGETS.items()) + " END"


@register("m12_cost_from_latency", with_fixtures(
    f"""SELECT model, task, tps AS tokens_per_second, round(2.5 / (tps * 3600) * 1e6, 4) AS cost_per_1m_tokens,
        CASE WHEN 10.0 - round(2.5 / (tps * 3600) * 1e6, 4) <= 0 THEN 'inf'::double
             ELSE round(25.0 / (10.0 - round(2.5 / (tps * 3600) * 1e6, 4)) * 1e6, 0) END AS roi_breakeven_tokens
    FROM (SELECT model, task, {_BUD_SQL} / (latency_ms / 1000) AS tps FROM bench) q""",
    "runs", extra=[("bench", _BENCH)]))
def m12_cost_from_latency(spark, sf):
    b = B.latest_benchmark(fx.runs(spark, sf))
    tps = throughput("latency_ms", task="task", budgets=_BUDGETS)
    cost = slm_cost_per_1m(tps)
    return b.select("model", "task", tps.alias("tokens_per_second"), cost.alias("cost_per_1m_tokens"),
                    roi_breakeven(F.lit(25.0), F.lit(10.0), cost).alias("roi_breakeven_tokens"))


# ---------------------------------------------------------------- decisions
_CAND = """SELECT s.*, m.model, m.method, m.accuracy, m.cost_per_1m_tokens, m.privacy_risk,
        m.roi_breakeven_tokens, m.latency_ms
    FROM scenarios s JOIN matrix m ON m.task = s.task
    WHERE NOT s.privacy_required OR m.privacy_risk = 'low'"""
_ELIG = "SELECT *, cost_per_1m_tokens / 1e6 * monthly_volume AS projected_monthly_cost FROM cand WHERE accuracy >= min_accuracy"
_REC = """SELECT scenario, model, method, accuracy, cost_per_1m_tokens, privacy_risk, roi_breakeven_tokens,
        projected_monthly_cost, n_eligible_candidates FROM (
        SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY projected_monthly_cost ASC NULLS LAST, model) AS rn,
               count(*) OVER (PARTITION BY scenario) AS n_eligible_candidates FROM elig) q WHERE rn = 1"""
DEC_CTES = [("cand", _CAND), ("elig", _ELIG), ("rec", _REC)]


def decision_sql(body: str, extra=()) -> str:
    return matrix_sql(body, "scenarios", extra=DEC_CTES + list(extra))


@register("d1_recommend", decision_sql("SELECT * FROM rec"))
def d1_recommend(spark, sf):
    return D.recommend(fixture_matrix(spark, sf), fx.scenarios(spark, sf))


@register("d1_recommend_asof", decision_sql("SELECT * FROM rec"))
def d1_recommend_asof(spark, sf):
    """D1 as an as-of lookup on per-task staircases (no scenario x model rows)."""
    return D.recommend_asof(fixture_matrix(spark, sf), fx.scenarios(spark, sf))


@register("d2_fallback", decision_sql(
    """SELECT scenario, rank, model, method, accuracy, cost_per_1m_tokens, privacy_risk FROM (
        SELECT *, (row_number() OVER (PARTITION BY scenario ORDER BY accuracy DESC NULLS LAST, model))::int AS rank
        FROM cand WHERE scenario NOT IN (SELECT scenario FROM rec)) q WHERE rank <= 3"""))
def d2_fallback(spark, sf):
    return D.fallback(fixture_matrix(spark, sf), fx.scenarios(spark, sf))


@register("d3_projected_cost", decision_sql(
    "SELECT scenario, model, cost_per_1m_tokens / 1e6 * monthly_volume AS projected_monthly_cost FROM cand"))
def d3_projected_cost(spark, sf):
    c = D.candidates(fixture_matrix(spark, sf), fx.scenarios(spark, sf))
    return c.select("scenario", "model", D.projected_cost("cost_per_1m_tokens", "monthly_volume")
                    .alias("projected_monthly_cost"))


@register("d4_eligible_count", decision_sql(
    """SELECT s.scenario, coalesce(r.n_eligible_candidates, 0) AS n_eligible_candidates
    FROM scenarios s LEFT JOIN rec r ON r.scenario = s.scenario"""))
def d4_eligible_count(spark, sf):
    return D.validation_report(fixture_matrix(spark, sf), fx.scenarios(spark, sf)) \
        .select("scenario", F.col("n_eligible_candidates").cast("bigint").alias("n_eligible_candidates"))


@register("d5_validation_report", decision_sql(
    """SELECT s.scenario, s.task, s.monthly_volume, s.min_accuracy, s.privacy_required,
        coalesce(r.model, 'NONE (no model meets constraints)') AS recommended_model,
        coalesce(r.method, '-') AS recommended_method,
        round(r.accuracy, 4) AS accuracy, round(r.projected_monthly_cost, 2) AS projected_monthly_cost_usd,
        cast(coalesce(r.n_eligible_candidates, 0) AS int) AS n_eligible_candidates
    FROM scenarios s LEFT JOIN rec r ON r.scenario = s.scenario"""))
def d5_validation_report(spark, sf):
    return D.validation_report(fixture_matrix(spark, sf), fx.scenarios(spark, sf))


_REF = "(SELECT min(cost_per_1m_tokens) FROM matrix WHERE model = 'gpt-4o')"
_IMPLIED = f"""SELECT model, task, {_REF} AS reference_api_cost,
        CASE WHEN roi_breakeven_tokens IS NULL OR isnan(roi_breakeven_tokens) OR roi_breakeven_tokens = 'inf'::double
                  OR privacy_risk <> 'low' THEN 0.0
             ELSE ({_REF} - cost_per_1m_tokens) / 1e6 * roi_breakeven_tokens END AS implied_fine_tuning_cost
    FROM matrix"""


@register("d6_reference_api_cost", matrix_sql(f"SELECT DISTINCT {_REF} AS reference_api_cost FROM matrix"))
def d6_reference_api_cost(spark, sf):
    m = fixture_matrix(spark, sf)
    return m.select(D.reference_api_cost(m).alias("reference_api_cost")).distinct()


@register("d7_implied_fine_tuning_cost", matrix_sql(_IMPLIED))
def d7_implied_fine_tuning_cost(spark, sf):
    return D.implied_fine_tuning_cost(fixture_matrix(spark, sf)) \
        .select("model", "task", "reference_api_cost", "implied_fine_tuning_cost")


@register("d8_cost_curves", decision_sql(
    """SELECT r.scenario, r.model, v.volume,
        coalesce(i.implied_fine_tuning_cost, 0.0) + r.cost_per_1m_tokens / 1e6 * v.volume AS slm_cost,
        i.reference_api_cost / 1e6 * v.volume AS api_cost
    FROM rec r JOIN scenarios s ON s.scenario = r.scenario
    LEFT JOIN implied i ON i.model = r.model AND i.task = s.task
    CROSS JOIN LATERAL (SELECT unnest(range(0::bigint,
            greatest(20000000, cast(trunc(s.monthly_volume * 1.2) AS bigint)),
            greatest(greatest(20000000, cast(trunc(s.monthly_volume * 1.2) AS bigint)) // 100, 1))) AS volume) v
    WHERE r.privacy_risk = 'low'""", extra=[("implied", _IMPLIED)]))
def d8_cost_curves(spark, sf):
    return D.cost_curves(fixture_matrix(spark, sf), fx.scenarios(spark, sf))


@register("d9_ranked_candidates", matrix_sql(
    """SELECT task, model, method, accuracy, cost_per_1m_tokens, latency_ms, privacy_risk,
        (row_number() OVER (PARTITION BY task ORDER BY accuracy DESC NULLS LAST, model))::int AS rank FROM matrix"""))
def d9_ranked_candidates(spark, sf):
    return D.ranked_candidates(fixture_matrix(spark, sf))


@register("d10_cost_chart", decision_sql(
    """SELECT scenario, model, cost_per_1m_tokens / 1e6 * monthly_volume AS projected_monthly_cost,
        CASE WHEN privacy_risk = 'low' THEN 'on_premise' ELSE 'api' END AS deployment,
        (row_number() OVER (PARTITION BY scenario ORDER BY cost_per_1m_tokens / 1e6 * monthly_volume ASC NULLS LAST, model))::int AS rank
    FROM cand"""))
def d10_cost_chart(spark, sf):
    return D.cost_chart(fixture_matrix(spark, sf), fx.scenarios(spark, sf))


@register("d11_breakeven_verdict", matrix_sql(
    """SELECT model, task,
        CASE WHEN roi_breakeven_tokens IS NULL OR roi_breakeven_tokens = 'inf'::double THEN 'never' ELSE 'at_volume' END AS verdict,
        CASE WHEN roi_breakeven_tokens IS NULL OR roi_breakeven_tokens = 'inf'::double THEN NULL ELSE roi_breakeven_tokens END AS breakeven_tokens
    FROM matrix"""))
def d11_breakeven_verdict(spark, sf):
    return D.breakeven_verdict(fixture_matrix(spark, sf))


# ---------------------------------------------------------------- M14-M16 standalone
@register("m14_roi_breakeven", with_fixtures(
    """SELECT b.model, b.task,
        CASE WHEN 10.0 - b.cost_per_1m_tokens <= 0 THEN 'inf'::double
             ELSE round(t.training_hours * 2.5 / (10.0 - b.cost_per_1m_tokens) * 1e6, 0) END AS roi_vs_gpt4o,
        CASE WHEN 1.4 - b.cost_per_1m_tokens <= 0 THEN 'inf'::double
             ELSE round(t.training_hours * 2.5 / (1.4 - b.cost_per_1m_tokens) * 1e6, 0) END AS roi_vs_gemini
    FROM bench b JOIN train t ON t.model_short = regexp_replace(b.model, '^.*/', '') AND t.task = b.task""",
    "runs", extra=[("bench", _BENCH), ("train", _TRAIN)]))
def m14_roi_breakeven(spark, sf):
    from evalspark.functions.text import short_model
    from evalspark.operators.economics import api_price

    r = fx.runs(spark, sf)
    b = B.latest_benchmark(r).withColumn("model_short", short_model("model"))
    t = B.training_info(r)
    j = b.join(t.select("model_short", "task", "training_hours").withColumnRenamed("training_hours", "t_hours"),
               ["model_short", "task"])
    ft = training_cost("t_hours", decimals=None)
    return j.select("model", "task",
                    roi_breakeven(ft, api_price(F.lit("gpt-4o")), F.col("cost_per_1m_tokens")).alias("roi_vs_gpt4o"),
                    roi_breakeven(ft, api_price(F.lit("gemini-2.5-flash")), F.col("cost_per_1m_tokens"))
                    .alias("roi_vs_gemini"))


_DEPLOY = {"m0": "api", "m1": "api", "m2": "on_premise", "m3": "on_premise", "m4": "private_cloud", "m5": "edge"}
_DEPLOY_SQL = "CASE regexp_replace(model, '^.*/', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DEPLOY.items()) + " END"


@register("m15_privacy_risk", with_fixtures(
    f"""SELECT model, task, {_DEPLOY_SQL} AS deployment,
        coalesce(CASE {_DEPLOY_SQL} WHEN 'api' THEN 'high' WHEN 'on_premise' THEN 'low' WHEN 'private_cloud' THEN 'medium' END,
                 'unknown') AS privacy_risk
    FROM bench""", "runs", extra=[("bench", _BENCH)]))
def m15_privacy_risk(spark, sf):
    from evalspark.functions.text import short_model
    from evalspark.operators.economics import privacy_risk

    dep = F.try_element_at(F.create_map(*[x for k, v in _DEPLOY.items() for x in (F.lit(k), F.lit(v))]),
                           short_model("model"))
    b = B.latest_benchmark(fx.runs(spark, sf))
    return b.select("model", "task", dep.alias("deployment"), privacy_risk(dep).alias("privacy_risk"))


@register("m16_api_price", matrix_sql(
    """SELECT model, task, CASE model WHEN 'gpt-4o' THEN 5.0 WHEN 'claude-haiku-4-5' THEN 1.0 WHEN 'gemini-2.5-flash' THEN 0.3 END::double AS input_price,
        CASE model WHEN 'gpt-4o' THEN 15.0 WHEN 'claude-haiku-4-5' THEN 5.0 WHEN 'gemini-2.5-flash' THEN 2.5 END::double AS output_price,
        CASE model WHEN 'gpt-4o' THEN 10.0 WHEN 'claude-haiku-4-5' THEN 3.0 WHEN 'gemini-2.5-flash' THEN 1.4 END::double AS blended_price
    FROM matrix"""))
def m16_api_price(spark, sf):
    from evalspark.operators.economics import api_price

    m = fixture_matrix(spark, sf)
    return m.select("model", "task", api_price("model", "input").alias("input_price"),
                    api_price("model", "output").alias("output_price"),
                    api_price("model", "blended").alias("blended_price"))
