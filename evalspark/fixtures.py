"""Derived input views built from the driver tables (see FIXTURES.md, part B).

Each builder reads whole tables and returns a lazy DataFrame; the DuckDB oracle builds the
same view with the SQL in ``evalspark.oracle``.  Literal model lists are expanded with
``explode`` (a narrow generator), never with a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.hashing import h32
from evalspark.session import read_table

PRED_MODELS = ["m0", "m1", "m2"]
PRED_LABELS = ["bad", "good"]
NL = "\n"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    df = lab.select("doc_id", "quality", F.explode(F.array(*[F.lit(m) for m in PRED_MODELS])).alias("model"))
    hk = h32(F.concat(F.col("model"), F.lit(":"), F.col("doc_id").cast("string"))) % 10
    good = F.col("quality") == 1
    pred = (F.when(hk == 0, F.lit("error"))
            .when(hk == 1, F.lit("I cannot say"))
            .when(hk.isin(2, 3), F.when(good, F.lit("Answer: BAD.")).otherwise(F.lit("Answer: GOOD.")))
            .when(hk.isin(4, 5), F.when(good, F.lit(" good ")).otherwise(F.lit(" bad ")))
            .otherwise(F.when(good, F.lit("good")).otherwise(F.lit("bad"))))
    lat = (F.lit(100) + h32(F.concat(F.lit("lat"), F.col("model"), F.col("doc_id").cast("string"))) % 12000
           ).cast("double") / 1000
    return df.select(
        F.col("doc_id").alias("sample_id"), "model", F.lit("classification").alias("task"),
        F.when(good, F.lit("good")).otherwise(F.lit("bad")).alias("true_label"),
        pred.alias("prediction"), lat.alias("latency_s"))


def generations(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    tail = (F.when(F.col("event_id") % 4 == 0, F.lit(NL + "print(f(1))"))
            .when(F.col("event_id") % 4 == 1, F.lit(NL + "# done" + NL + "class A:"))
            .when(F.col("event_id") % 4 == 2, F.lit(NL + "def g(y):"))
            .otherwise(F.lit("")))
    return ev.select(
        F.col("event_type").alias("model"), F.col("user_id").alias("problem_id"),
        F.col("event_id").alias("sample_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("sampled")).otherwise(F.lit("greedy")).alias("config"),
        F.when(F.col("value") > 35, 1).otherwise(0).alias("passed"),
        F.concat(F.lit("def f(x):" + NL + "    return "), F.col("event_id").cast("string"), tail).alias("code"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return ev.select(
        F.md5(e.cast("string")).alias("run_id"), F.col("ts").alias("start_time"), (e % 2).alias("store"),
        F.concat(F.lit("org"), (u % 2).cast("string"), F.lit("/m"), (u % 6).cast("string")).alias("model"),
        F.col("event_type").alias("task"),
        F.when(e % 3 == 0, "phase2_fine_tuning").when(e % 3 == 1, "phase2_benchmark")
        .otherwise("phase1_baseline").alias("phase"),
        F.when(u % 6 >= 3, "low").otherwise("high").alias("privacy_risk"),
        F.when(u % 2 == 0, "LoRA").otherwise("QLoRA").alias("method"),
        F.least(v / 100, F.lit(1.0)).alias("accuracy"),
        (100 + v * 10).alias("latency_ms"),
        (1 + v / 10).alias("cost_per_1m_tokens"),
        (v / 100).alias("training_hours"))


def runs_log(spark: SparkSession, sf: str) -> DataFrame:
    """The run log in its map-typed form: tags / params / metrics maps."""
    r = runs(spark, sf)
    tags = F.create_map(F.lit("model"), F.col("model"), F.lit("task"), F.col("task"),
                        F.lit("phase"), F.col("phase"), F.lit("privacy_risk"), F.col("privacy_risk"),
                        F.lit("method"), F.col("method"))
    metrics = F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("latency_ms"), F.col("latency_ms"),
                           F.lit("cost_per_1m_tokens"), F.col("cost_per_1m_tokens"),
                           F.lit("training_hours"), F.col("training_hours"))
    return r.select("run_id", F.col("task").alias("experiment"), "start_time", "store",
                    tags.alias("tags"), F.create_map().cast("map<string,string>").alias("params"),
                    metrics.alias("metrics"))


def runs_wide(spark: SparkSession, sf: str, experiment_cols=("task", "store")) -> DataFrame:
    """Wide API-baseline runs: one run per experiment, metrics keyed ``<prefix>_<metric>``."""
    r = runs(spark, sf)
    metrics = F.create_map(
        F.lit("a_accuracy"), F.col("accuracy"),
        F.lit("a_avg_latency_s"), F.col("latency_ms") / 1000,
        F.lit("b_accuracy"), F.col("accuracy") / 2)
    return r.select(*experiment_cols, "run_id", "start_time", metrics.alias("metrics"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, ["conv_id", "turn"])


PHRASE_LABEL = {0: "negative", 1: " Neutral ", 2: "positive", 3: "a@positive", 4: "mixed"}


def phrase(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    lab = F.element_at(F.create_map(*[x for k, v in PHRASE_LABEL.items() for x in (F.lit(k), F.lit(v))]),
                       (F.col("doc_id") % 5).cast("int"))
    line = F.concat(F.regexp_replace(F.col("text"), NL, " "), F.lit("@"), lab)
    return d.select("doc_id", line.alias("line"))


def ner_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Array form: one row per turn with ``tokens`` (the blank-separated tokens of the whole
    turn) and BIO ``tags``.  The tag of a token looks at the previous token of the same array
    (no window, no shuffle)."""
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    toks = F.split(F.col("text"), " ")
    df = conv.select("conv_id", "turn", toks.alias("tokens"))

    def tag(t, i):
        cap = t.rlike("^[A-Z]")
        prev_cap = F.when(i > 0, F.col("tokens")[i - 1].rlike("^[A-Z]")).otherwise(F.lit(False))
        ty = h32(t) % 4
        return F.when(~cap, F.lit(0)).when(prev_cap, 2 * ty + 2).otherwise(2 * ty + 1).cast("int")

    return df.select("conv_id", "turn", "tokens", F.transform("tokens", tag).alias("tags"))


def nertok(spark: SparkSession, sf: str) -> DataFrame:
    """Exploded form: one row per (conv_id, turn, pos) token with its tag."""
    t = ner_tokens(spark, sf)
    return t.select("conv_id", "turn", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "z")) \
        .select("conv_id", "turn", "pos", F.col("z.tokens").alias("tok"), F.col("z.tags").alias("tag"))


def ner_response(spans: str, turn: str = "turn"):
    """The answer of ``ner_pred`` as an expression over one row's spans; NULL if there are none."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["pos"].alias("pos"), x["surface"].alias("surface"))))
    ranked = F.transform(ordered, lambda x, i: F.struct((i + 1).alias("rk"), x["surface"].alias("v")))
    kept = F.transform(F.filter(ranked, lambda y: y["rk"] % 3 != 0), lambda y: y["v"])
    js = F.concat(F.lit('{"PER": '), F.to_json(kept), F.lit("}"))
    return F.when(F.size(spans) > 0, F.when(F.col(turn) % 4 == 1, F.concat(F.lit("```json" + NL), js, F.lit(NL + "```")))
                  .when(F.col(turn) % 4 == 3, F.substring(js, 1, 10)).otherwise(js))


def ner_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers for the ner view: kept span surfaces as ``{"PER": [...]}`` JSON, fenced for
    turn % 4 = 1, cut to 10 characters (invalid JSON on purpose) for turn % 4 = 3."""
    from evalspark.functions.entities import bio_spans

    t = ner_tokens(spark, sf)
    sp = t.select("conv_id", "turn", F.explode(bio_spans("tokens", "tags")).alias("s")) \
        .select("conv_id", "turn", F.col("s.pos").alias("pos"), F.col("s.surface").alias("surface"))
    # rank within the turn without a window: one turn's spans are collected (one turn's text)
    g = sp.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("s"))
    kept = F.transform(F.filter(F.transform(g["s"], lambda x, i: F.struct((i + 1).alias("rk"), x["surface"].alias("v"))),
                                lambda y: y["rk"] % 3 != 0), lambda y: y["v"])
    js = F.concat(F.lit('{"PER": '), F.to_json(kept), F.lit("}"))
    resp = (F.when(F.col("turn") % 4 == 1, F.concat(F.lit("```json" + NL), js, F.lit(NL + "```")))
            .when(F.col("turn") % 4 == 3, F.substring(js, 1, 10))
            .otherwise(js))
    return g.select("conv_id", "turn", resp.alias("response"))


def paired(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("model"),
                     F.date_trunc("month", "o_orderdate").alias("unit")) \
        .agg(F.avg("o_totalprice").alias("score"))


SCENARIO_TASKS = ["click", "error", "purchase", "signup", "view"]


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """One deployment scenario per customer: volumes from 0 to 50M tokens a month, thresholds from
    0 to 1.59 (above 1 nobody qualifies)."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    task = F.element_at(F.array(*[F.lit(t) for t in SCENARIO_TASKS]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return c.select(F.concat(F.lit("s"), key.cast("string")).alias("scenario"), task.alias("task"),
                    ((key * 7919) % 50000000).cast("bigint").alias("monthly_volume"),
                    ((key % 160).cast("double") / 100).alias("min_accuracy"), (key % 3 == 0).alias("privacy_required"))


# Fixture settings for the run-log matrix: the wide runs' prefixes stand for two APIs.
API_PREFIXES = {"a": "gpt-4o", "b": "gemini-2.5-flash"}
API_TASK_METRIC = "accuracy"


# --- deterministic predictor for I1 / ST1 tests ------------------------------------------------

def _h32_py(s: str) -> int:
    import hashlib

    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16)


def flaky_first_word_predictor():
    """Factory: ``predict(prompts) -> first whitespace token of each prompt``.  A prompt whose
    md5-prefix hash is divisible by 17 fails on every odd-numbered call for that prompt, so each
    row scored one prompt at a time (duplicates included) succeeds on its second attempt."""
    calls: dict = {}

    def predict(prompts):
        out = []
        for p in prompts:
            if _h32_py(p) % 17 == 0:
                calls[p] = calls.get(p, 0) + 1
                if calls[p] % 2 == 1:
                    raise RuntimeError("transient failure")
            parts = p.split()
            out.append(parts[0] if parts else "")
        return out

    return predict


def always_failing_predictor():
    def predict(prompts):
        raise TimeoutError("model unavailable")

    return predict


def first_word_predictor():
    """First whitespace token of each prompt."""
    return lambda prompts: [(p.split() or [""])[0] for p in prompts]


def length_predictor():
    """The number of letters of each prompt."""
    return lambda prompts: [str(len(p)) for p in prompts]


def impatient_predictor():
    """First words, but a call within 25 ms of this worker's last one is refused."""
    import time

    from evalspark.operators.pacing import Refused

    last, words = [0.0], first_word_predictor()

    def predict(prompts):
        now = time.time()
        early, last[0] = now - last[0] < 0.025, now
        if early:
            raise Refused("too many calls")
        return words(prompts)

    return predict


def refusing_predictor():
    """First words; the calls that ``flaky_first_word_predictor`` fails are refused for 20 ms."""
    from evalspark.operators.pacing import Refused

    flaky = flaky_first_word_predictor()

    def predict(prompts):
        try:
            return flaky(prompts)
        except RuntimeError as e:
            raise Refused(str(e), retry_after=0.02) from e

    return predict
