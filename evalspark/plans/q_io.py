"""Catalog section: sources and sinks (S*), scoring jobs (I*) and incremental scoring (ST1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import fixtures as fx
from evalspark.config import PHASE1_EXPERIMENT_TASKS, PHASE1_MODEL_PREFIXES, PROMPT_TRUNCATE_CHARS
from evalspark.functions.text import short_model
from evalspark.operators import matrix as B
from evalspark.operators import progress as PG
from evalspark.operators import scoring as I
from evalspark.operators.pacing import AT_ONCE, RateLimit, Retry
from evalspark.operators.prepare import format_samples
from evalspark.oracle import H, with_fixtures
from evalspark.plans.benchmark import fixture_matrix
from evalspark.plans.catalog import register
from evalspark.plans.q_core import MATRIX_CTES
from evalspark.schemas import MATRIX_SCHEMA
from evalspark.session import read_table, scratch_path
from evalspark.sources import datasets as S3
from evalspark.sources import results_csv as CSV
from evalspark.sources import runs as RS
from evalspark.sources import text_label as S2


# ---------------------------------------------------------------- S1 / S8
@register("s1_s8_matrix_csv_roundtrip", with_fixtures("SELECT * FROM matrix", "runs", extra=MATRIX_CTES))
def s1_s8_matrix_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "matrix-csv")
    CSV.write_results_csv(fixture_matrix(spark, sf), path)
    return CSV.read_results_csv(spark, path, MATRIX_SCHEMA)


# ---------------------------------------------------------------- S2
_PH = [("ph", r"SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS l FROM phrase"),
       ("sp", r"""SELECT regexp_extract(l, '(?s)^(.*)@([^@]*)$', 1) AS sentence,
            lower(regexp_replace(regexp_extract(l, '(?s)^(.*)@([^@]*)$', 2), '^\s+|\s+$', '', 'g')) AS sentiment
            FROM ph WHERE l <> '' AND contains(l, '@')""")]


@register("s2_labelled_text_file", with_fixtures(
    """SELECT sentence, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS label
    FROM sp WHERE sentiment IN ('negative', 'neutral', 'positive')""", "phrase", extra=_PH))
def s2_labelled_text_file(spark, sf):
    path = scratch_path(spark, "phrase-latin1")
    S2.write_lines(fx.phrase(spark, sf), "line", path, encoding="ISO-8859-1", line_sep="\r\n")
    return S2.read_labelled_text(spark, path)


# ---------------------------------------------------------------- S3
def _storage(sf):
    """Documents stand for the tasks' data: one table (split 80/10/10), or a train and a test table
    (validation carved out of train)."""
    one = {"path": f"{sf}/documents.parquet", "input_col": "text", "label_col": "lang", "id_col": "doc_id"}
    two = {"paths": {"train": f"{sf}/documents.parquet", "test": f"{sf}/conversations.parquet"}, "input_col": "text",
           "label_col": "lang", "id_col": "doc_id"}
    return {"doc_language": one, "financial_sentiment": one, "classification": two}


@register("s3_load_task_dataset", "SELECT doc_id, lang, length(text)::int AS n_chars FROM documents")
def s3_load_task_dataset(spark, sf):
    df, cfg = S3.load_task_dataset(spark, "doc_language", _storage(sf))
    return df.select("doc_id", F.col(cfg["label_col"]).alias("lang"), F.length(cfg["input_col"]).alias("n_chars"))


_S3_B1 = H("concat('42', ':', cast(doc_id AS varchar))") + " % 10000"
_S3_B2 = H("concat('42:2', ':', cast(doc_id AS varchar))") + " % 10000"
_S3_PROMPTS = {
    "financial_sentiment": ("'Classify the sentiment of this financial statement (negative / neutral / positive):'", "'Sentiment:'"),
    "classification": ("'Classify this news article into exactly one category (World / Sports / Business / Technology):'", "'Category:'")}


def _register_split(task, split, where):
    head, tail = _S3_PROMPTS[task]

    @register(f"s3_{task}_{split}", f"""SELECT doc_id, concat({head}, chr(10), substr(text, 1, 400), chr(10), {tail}) AS prompt,
        lang AS completion FROM documents WHERE {where}""")
    def query(spark, sf):
        """S3 + P1/P2 + P8: the split of a task's data, as prompts of its template."""
        df, cfg = S3.load_task_dataset(spark, task, _storage(sf), split)
        out = format_samples(df, cfg["prompt_template"], cfg["input_col"], F.col(cfg["label_col"]), PROMPT_TRUNCATE_CHARS)
        return out.select("doc_id", "prompt", "completion")


_register_split("financial_sentiment", "train", f"{_S3_B1} < 8000")
_register_split("financial_sentiment", "validation", f"{_S3_B1} >= 8000 AND {_S3_B1} < 9000")
_register_split("financial_sentiment", "test", f"{_S3_B1} >= 9000")
_register_split("classification", "train", f"{_S3_B2} < 9000")
_register_split("classification", "validation", f"{_S3_B2} >= 9000")


# ---------------------------------------------------------------- S4-S7: run store
def _write_store(spark, sf):
    r = fx.runs(spark, sf)
    rec = RS.run_records(r, "task", "run_id", "start_time",
                         tags={"model": "model", "task": "task", "phase": "phase", "privacy_risk": "privacy_risk",
                               "method": "method"},
                         metrics={"accuracy": "accuracy", "latency_ms": "latency_ms",
                                  "cost_per_1m_tokens": "cost_per_1m_tokens", "training_hours": "training_hours"},
                         params={"store": F.col("store")})
    path = scratch_path(spark, "runs")
    # two appends (one per store) into one table: S6 / S7 batch one write per logging call
    RS.append_runs(rec.filter(F.col("params")["store"] == "0"), path)
    RS.append_runs(rec.filter(F.col("params")["store"] == "1"), path)
    return path


@register("s6_s7_append_runs", with_fixtures(
    "SELECT run_id, task AS experiment, phase, model, accuracy, training_hours FROM runs", "runs"))
def s6_s7_append_runs(spark, sf):
    path = _write_store(spark, sf)
    r = spark.read.parquet(path)
    return r.select("run_id", "experiment", "phase", F.col("tags")["model"].alias("model"),
                    F.col("metrics")["accuracy"].alias("accuracy"),
                    F.col("metrics")["training_hours"].alias("training_hours"))


@register("s4_search_runs", with_fixtures(
    """SELECT run_id, task AS experiment, model, accuracy FROM runs
    WHERE task IN ('click', 'view') AND phase = 'phase2_benchmark'""", "runs"))
def s4_search_runs(spark, sf):
    path = _write_store(spark, sf)
    r = RS.read_runs(spark, path)
    r = r.filter(F.col("experiment").isin("click", "view") & (F.col("phase") == "phase2_benchmark"))
    return r.select("run_id", "experiment", F.col("tags")["model"].alias("model"),
                    F.col("metrics")["accuracy"].alias("accuracy"))


_TOP_RUNS = """SELECT run_id, task AS experiment, model, accuracy FROM (SELECT *, row_number() OVER ({over}
        ORDER BY accuracy DESC NULLS LAST, run_id) AS place FROM runs WHERE {where}) q WHERE place <= {n}"""


def _searched(found):
    return found.select("run_id", "experiment", F.col("tags")["model"].alias("model"), F.col("metrics")["accuracy"].alias("accuracy"))


@register("s4_top_runs", with_fixtures(_TOP_RUNS.format(over="", where="task IN ('click', 'view') AND phase = 'phase2_benchmark'", n=25), "runs"))
def s4_top_runs(spark, sf):
    """Search with an order and a limit over the chosen experiments together."""
    return _searched(RS.search_runs(spark, _write_store(spark, sf), experiments=["click", "view"], phase="phase2_benchmark",
                                    order_by=["metrics.accuracy DESC"], max_results=25))


@register("s4_top_runs_per_experiment", with_fixtures(_TOP_RUNS.format(over="PARTITION BY task", where="true", n=5), "runs"))
def s4_top_runs_per_experiment(spark, sf):
    return _searched(RS.search_runs(spark, _write_store(spark, sf), order_by=["metrics.accuracy DESC"], max_results=5,
                                    per_experiment=True))


@register("s5_union_stores", with_fixtures(
    "SELECT run_id, store, model, CASE WHEN store = 0 THEN NULL ELSE privacy_risk END AS privacy_risk FROM runs",
    "runs"))
def s5_union_stores(spark, sf):
    r = fx.runs(spark, sf)
    old = r.filter(F.col("store") == 0).select("run_id", "store", "model")  # older schema generation
    new = r.filter(F.col("store") == 1).select("run_id", "store", "model", "privacy_risk")
    return RS.union_stores(old, new)


# ---------------------------------------------------------------- I1-I4
def _prompts(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return d


_FIRST = r"string_split_regex(regexp_replace(prompt, '^\s+', ''), '\s+')[1]"
_I1 = f"""SELECT doc_id, {_FIRST} AS prediction,
        CASE WHEN {H('prompt')} % 17 = 0 THEN 2 ELSE 1 END AS attempts, 'ok' AS status
    FROM (SELECT doc_id, text AS prompt FROM documents) q"""


@register("i1_score", _I1)
def i1_score(spark, sf):
    s = I.score(_prompts(spark, sf), fx.flaky_first_word_predictor, keep=["doc_id"], retry=AT_ONCE)
    return s.select("doc_id", "prediction", "attempts", "status")


@register("i1_score_failures", """SELECT doc_id, 'error' AS prediction, 3 AS attempts, 'error' AS status,
    'TimeoutError: model unavailable' AS error FROM documents""")
def i1_score_failures(spark, sf):
    s = I.score(_prompts(spark, sf), fx.always_failing_predictor, keep=["doc_id"], batch_mode=True, retry=AT_ONCE)
    return s.select("doc_id", "prediction", "attempts", "status", "error")


@register("i1_rate_limited", f"""SELECT doc_id, {_FIRST} AS prediction, 1 AS attempts, 'ok' AS status
    FROM (SELECT doc_id, text AS prompt FROM documents) q""")
def i1_rate_limited(spark, sf):
    """A provider that refuses calls in quick succession refuses none under its rate limit."""
    s = I.score(_prompts(spark, sf), fx.impatient_predictor, keep=["doc_id"], batch_mode=True, rate=RateLimit(calls_per_s=20.0))
    return s.select("doc_id", "prediction", "attempts", "status")


@register("i1_refusals_waited", f"""SELECT doc_id, {_FIRST} AS prediction,
        CASE WHEN {H('prompt')} % 17 = 0 THEN 2 ELSE 1 END AS attempts, 'ok' AS status
    FROM (SELECT doc_id, text AS prompt FROM documents) q""")
def i1_refusals_waited(spark, sf):
    """Refusals name a wait of 20 ms, which is kept before the next attempt."""
    s = I.score(_prompts(spark, sf), fx.refusing_predictor, keep=["doc_id"], retry=Retry(wait_s=0.0))
    return s.select("doc_id", "prediction", "attempts", "status")


_TWO_RUNS = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_FIRST} ELSE cast(length(prompt) AS varchar) END AS prediction,
    1 AS attempts, 'ok' AS status FROM (SELECT doc_id, text AS prompt FROM documents) q"""


@register("i2_durable_chunks", _TWO_RUNS)
def i2_durable_chunks(spark, sf):
    """A job over half of the samples, then one over all with another model: what the first has
    committed stays, chunk by chunk."""
    folder, prompts = scratch_path(spark, "chunks"), _prompts(spark, sf)
    PG.score_durably(prompts.filter(F.col("doc_id") % 2 == 0), fx.first_word_predictor, "doc_id", folder, keep=["doc_id"])
    scored = PG.score_durably(prompts, fx.length_predictor, "doc_id", folder, keep=["doc_id"])
    return scored.select("doc_id", "prediction", "attempts", "status")


@register("i2_resume", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id AND x.doc_id % 2 = 0)")
def i2_resume(spark, sf):
    prompts = _prompts(spark, sf)
    done = read_table(spark, sf, "documents").select("doc_id").filter(F.col("doc_id") % 2 == 0)
    return I.resume(prompts, done, "doc_id").select("doc_id")


_GRID_MODELS = [f"m{i}" for i in range(7)]
_GRID_TASKS = ["click", "error", "purchase", "signup", "view", "train"]


def _vals(xs):
    return ", ".join(f"('{x}')" for x in xs)


@register("i3_pending_grid", with_fixtures(
    f"""SELECT gm.model, gt.task FROM (VALUES {_vals(_GRID_MODELS)}) AS gm(model), (VALUES {_vals(_GRID_TASKS)}) AS gt(task)
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE regexp_replace(r.model, '^.*/', '') = gm.model AND r.task = gt.task
                      AND r.phase = 'phase2_benchmark')""", "runs"))
def i3_pending_grid(spark, sf):
    done = fx.runs(spark, sf).filter(F.col("phase") == "phase2_benchmark") \
        .select(short_model("model").alias("model"), "task")
    return B.missing_cells(done, _GRID_MODELS, _GRID_TASKS)


@register("i4_failure_summary", with_fixtures(
    """SELECT model, task, count(*) AS n, sum(CASE WHEN prediction IN ('error', 'Error', 'Unknown', 'unknown', '{}', '')
        THEN 1 ELSE 0 END)::bigint AS n_failed,
        sum(CASE WHEN prediction IN ('error', 'Error', 'Unknown', 'unknown', '{}', '') THEN 1 ELSE 0 END) / count(*) AS failure_rate
    FROM predictions GROUP BY model, task""", "predictions"))
def i4_failure_summary(spark, sf):
    return I.failure_summary(I.with_status(fx.predictions(spark, sf)))


# ---------------------------------------------------------------- ST1
@register("st1_incremental_scoring", _I1)
def st1_incremental_scoring(spark, sf):
    from evalspark.streaming.incremental import read_scored, run_incremental

    src, sink, ckpt = (scratch_path(spark, x) for x in ("st1-src", "st1-sink", "st1-ckpt"))
    prompts = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    schema = prompts.schema
    # first delivery: even ids; run; second delivery: odd ids; run again (only new files scored)
    prompts.filter(F.col("doc_id") % 2 == 0).write.mode("append").parquet(src)
    run_incremental(spark, src, schema, sink, ckpt, fx.flaky_first_word_predictor, keep=["doc_id"], retry=AT_ONCE)
    prompts.filter(F.col("doc_id") % 2 == 1).write.mode("append").parquet(src)
    run_incremental(spark, src, schema, sink, ckpt, fx.flaky_first_word_predictor, keep=["doc_id"], retry=AT_ONCE)
    return read_scored(spark, sink).select("doc_id", "prediction", "attempts", "status")


@register("st1_redelivery", _TWO_RUNS)
def st1_redelivery(spark, sf):
    """Samples delivered again (in one delivery and in a later one) keep their first score."""
    from evalspark.streaming.incremental import read_scored, run_incremental

    src, sink, ckpt = (scratch_path(spark, x) for x in ("st1-src", "st1-sink", "st1-ckpt"))
    prompts = _prompts(spark, sf)
    even = prompts.filter(F.col("doc_id") % 2 == 0)
    for delivery, predictor in (([even, even], fx.first_word_predictor), ([prompts, even], fx.length_predictor)):
        for part in delivery:
            part.write.mode("append").parquet(src)
        run_incremental(spark, src, prompts.schema, sink, ckpt, predictor, keep=["doc_id"], key="doc_id", retry=AT_ONCE)
    return read_scored(spark, sink).select("doc_id", "prediction", "attempts", "status")


# ---------------------------------------------------------------- S1 for wide prediction logs
@register("s1_wide_prediction_log", with_fixtures(
    "SELECT sample_id, true_label, model, prediction, latency_s FROM predictions", "predictions"))
def s1_wide_prediction_log(spark, sf):
    """A mixed-generation wide log (m2 in the older column naming) written as CSV, read back
    by header and unpivoted to long predictions."""
    from evalspark.sources import prediction_logs as PL

    models = fx.PRED_MODELS
    wide = PL.long_to_wide_log(fx.predictions(spark, sf), models, generation={"m2": "old"})
    path = scratch_path(spark, "wide-log")
    PL.write_wide_log(wide, path)
    log = PL.read_wide_log(spark, path)
    long = PL.wide_to_long_predictions(log, {m: m for m in models}, keep=("true_label",))
    return long.select(F.col("sample_id").cast("bigint").alias("sample_id"), "true_label", "model",
                       "prediction", "latency_s")


@register("b8_matrix_from_run_store", with_fixtures("SELECT * FROM matrix", "runs", extra=MATRIX_CTES))
def b8_matrix_from_run_store(spark, sf):
    """S6 -> S4 -> B8: the matrix compiled from the map-typed run store written by the logger
    (tags / metrics maps, partitioned by experiment), not from flat columns."""
    from evalspark.operators.matrix import compile_matrix

    store = RS.read_runs(spark, _write_store(spark, sf)).drop("store")
    wide = fx.runs_wide(spark, sf, experiment_cols=("task",))
    return compile_matrix(store, wide, fx.API_PREFIXES, experiment_cols=("task",), accuracy_key=fx.API_TASK_METRIC)


# ---------------------------------------------------------------- B1 by registry
_REG_EXPERIMENTS = ["ag_news_baseline", "conll2003_baseline", "cnn_dailymail_baseline", "other_baseline", "humaneval_baseline"]
_REG_SQL = """WITH e AS (SELECT md5(cast(event_id AS varchar)) AS run_id, ts, value,
         (['ag_news_baseline', 'conll2003_baseline', 'cnn_dailymail_baseline', 'other_baseline', 'humaneval_baseline'])[cast(user_id % 5 AS int) + 1] AS experiment
         FROM events),
     w AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY ts DESC, run_id) AS rn FROM e),
     r AS (SELECT *, CASE experiment WHEN 'ag_news_baseline' THEN 'classification' WHEN 'conll2003_baseline' THEN 'ner'
               WHEN 'cnn_dailymail_baseline' THEN 'summarization' WHEN 'humaneval_baseline' THEN 'code_generation' END AS task
           FROM w WHERE rn = 1 AND experiment <> 'other_baseline')
    SELECT m.model, r.task, 'API' AS method, r.value / m.d AS accuracy, round(r.value / 100 * 1000, 2) AS latency_ms,
        m.price AS cost_per_1m_tokens, 'high' AS privacy_risk, CAST(NULL AS double) AS roi_breakeven_tokens
    FROM r CROSS JOIN (VALUES ('gpt-4o', 10.0::double, 1), ('claude-haiku-4-5', 3.0::double, 2)) AS m(model, price, d)"""


@register("b1_registry_rows", _REG_SQL)
def b1_registry_rows(spark, sf):
    """B1 with the wide-run registry: registered experiments only, each by its own accuracy metric."""
    ev = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    name = F.element_at(F.array(*[F.lit(x) for x in _REG_EXPERIMENTS]), (F.col("user_id") % 5 + 1).cast("int"))
    metric = F.element_at(F.array(*[F.lit(PHASE1_EXPERIMENT_TASKS.get(x, ("", "accuracy"))[1]) for x in _REG_EXPERIMENTS]),
                          (F.col("user_id") % 5 + 1).cast("int"))
    value = F.col("value")
    metrics = F.create_map(F.concat(F.lit("openai_"), metric), value, F.concat(F.lit("anthropic_"), metric), value / 2,
                           F.lit("openai_avg_latency_s"), value / 100, F.lit("anthropic_avg_latency_s"), value / 100)
    runs = ev.select(F.md5(F.col("event_id").cast("string")).alias("run_id"), F.col("ts").alias("start_time"),
                     name.alias("experiment"), metrics.alias("metrics"))
    return B.registry_rows(runs, PHASE1_EXPERIMENT_TASKS, PHASE1_MODEL_PREFIXES)
