"""Library paths not exercised by the registered queries."""

import pytest
from pyspark.sql import functions as F

from evalspark import fixtures as fx
from evalspark.operators import prepare as P
from evalspark.operators import scoring as I
from evalspark.session import read_table, scratch_path
from evalspark.sources import datasets as S3
from evalspark.sources import text_label as S2


def test_pluggable_tokenizer_udf(spark):
    tok = P.tokenizer_udf(lambda texts: [[len(w) for w in t.split()] for t in texts])
    df = spark.createDataFrame([("ab cde", "f")], "prompt string, completion string")
    r = P.training_examples(df, tokenize=tok, eos_id=0).collect()[0]
    assert r.input_ids == [2, 3, 1, 0]
    assert r.labels == [-100, -100, 1, 0]
    assert r.attention_mask == [1, 1, 1, 1]


def test_training_examples_cap(spark):
    df = spark.createDataFrame([("a b c", "d e")], "prompt string, completion string")
    r = P.training_examples(df, max_length=4).collect()[0]
    assert len(r.input_ids) == 4 and r.labels[:3] == [-100] * 3 and r.labels[3] != -100


def test_chat_format_order_and_generation_prompt(spark):
    conv = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", "hello"), (2, 0, "system", "s")],
                                 "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.chat for r in P.chat_format(conv, add_generation_prompt=True).collect()}
    assert got[1] == "<|user|>hello<|end|><|assistant|>hi<|end|><|assistant|>"
    assert got[2] == "<|system|>s<|end|><|assistant|>"


def test_labelled_text_variants(spark):
    path = scratch_path(spark, "lines")
    df = spark.createDataFrame([("Café up @ Positive ",), ("no label line",), ("x@y@neutral",), ("bad@mixed",),
                                ("   ",)], "line string")
    S2.write_lines(df, "line", path)
    strict = sorted(tuple(r) for r in S2.read_labelled_text(spark, path).collect())
    assert strict == [("Café up ", 2), ("x@y", 1)]
    loose = sorted(tuple(r) for r in S2.read_labelled_text(spark, path, keep_unknown=True).collect())
    assert loose == [("Café up", "positive"), ("bad", "mixed"), ("x@y", "neutral")]


def test_load_task_dataset_errors(spark, sf):
    reg = {"t": {"path": f"{sf}/documents.parquet", "input_col": "text", "label_col": "nope"}}
    with pytest.raises(S3.UnknownTask):
        S3.load_task_dataset(spark, "other", reg)
    with pytest.raises(ValueError):
        S3.load_task_dataset(spark, "t", reg)
    ok = {"t": {"path": f"{sf}/documents.parquet", "input_col": "text", "label_col": "lang", "id_col": "doc_id"}}
    df, _ = S3.load_task_dataset(spark, "t", ok, max_samples=5)
    assert [r.doc_id for r in df.collect()] == [0, 1, 2, 3, 4]


def test_batch_mode_amortises_latency(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 30).alias("prompt"))

    def factory():
        return lambda prompts: [p[:3] for p in prompts]

    s = I.score(d, factory, keep=["doc_id"], batch_mode=True)
    r = s.agg(F.min("batch_size"), F.max("attempts"), F.count_if(F.col("status") == "ok"), F.count("*")).collect()[0]
    assert r[0] >= 1 and r[1] == 1 and r[2] == r[3]


def test_chat_segments_blocks_agree_and_rebuild_chat(spark, sf):
    conv = read_table(spark, sf, "conversations")
    small = sorted(tuple(r) for r in P.chat_segments(conv, block=2).collect())
    big = sorted(tuple(r) for r in P.chat_segments(conv).collect())
    assert small == big
    chats = {r.conv_id: r.chat for r in P.chat_format(conv).collect()}
    rebuilt = {}
    for cid, _, off, seg in big:
        assert len(rebuilt.get(cid, "")) == off
        rebuilt[cid] = rebuilt.get(cid, "") + seg
    assert rebuilt == chats


def test_wide_log_generations(spark, tmp_path):
    from evalspark.sources import prediction_logs as PL

    p = tmp_path / "log.csv"
    p.write_text("text,true_label,openai_pred,openai_correct,openai_latency_s,gemini_pred,gemini_latency\n"
                 "t1,World, World ,1,0.5,Sports,1.25\n")
    log = PL.read_wide_log(spark, str(p))
    rows = {r.model: r for r in PL.wide_to_long_predictions(
        log, {"openai": "gpt-4o", "gemini": "gemini-2.5-flash", "anthropic": "claude-haiku-4-5"},
        id_cols=("text",)).collect()}
    assert set(rows) == {"gpt-4o", "gemini-2.5-flash"}
    assert (rows["gpt-4o"].prediction, rows["gpt-4o"].correct, rows["gpt-4o"].latency_s) == (" World ", 1, 0.5)
    assert (rows["gemini-2.5-flash"].correct, rows["gemini-2.5-flash"].latency_s) == (None, 1.25)


def test_exact_copies_normalise_case_and_whitespace(spark):
    docs = spark.createDataFrame([(1, "The  Quick\nbrown fox"), (2, "the quick brown fox!"), (3, "other")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(10, " the quick brown   FOX ")], "item_id long, text string")
    assert sorted(tuple(r) for r in P.exact_overlap(docs, bench).collect()) == [(1, 1)]


def test_ngram_overlap_counts_items_and_grams(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x y z"), (3, "A, B. C d e f g h")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(10, "a b c d e f g h"), (11, "c d e f g h i j k")],
                                  "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_shared_ngrams) for r in P.ngram_overlap(docs, bench, n=8).collect()}
    assert got == {1: (2, 2), 3: (1, 1)}  # doc 1 shares a..h (item 10) and c..j (item 11)


def test_read_runs_several_stores(spark):
    from evalspark.sources import runs as RS

    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "m", "click", "phase2_benchmark", 0.5)],
                               "run_id long, ts string, model string, task string, phase string, acc double") \
        .withColumn("ts", F.to_timestamp("ts"))
    rec = RS.run_records(df, "task", "run_id", "ts", tags={"model": "model", "phase": "phase"},
                         metrics={"accuracy": "acc"})
    a, b = scratch_path(spark, "store-a"), scratch_path(spark, "store-b")
    RS.append_runs(rec, a)
    RS.append_runs(rec.withColumn("run_id", F.col("run_id") + 1), b)
    got = sorted((r.run_id, r.store, r.experiment, r.phase) for r in RS.read_runs(spark, a, b, store_names=["x", "y"]).collect())
    assert got == [(1, "x", "click", "phase2_benchmark"), (2, "y", "click", "phase2_benchmark")]


def test_dedupe_latest_and_cut_lineage(spark):
    from evalspark.session import cut_lineage
    from evalspark.streaming.incremental import dedupe_latest

    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "doc_id long, prediction string, attempts int")
    got = sorted(tuple(r) for r in dedupe_latest(df, "doc_id").collect())
    assert got == [(1, "b", 2), (2, "c", 1)]
    cp = cut_lineage(df.filter("doc_id = 1"))
    assert cp.count() == 2 and "LogicalRDD" in cp._jdf.queryExecution().logical().toString()


def test_missing_cells_grid(spark):
    from evalspark.operators import matrix as B

    m = spark.createDataFrame([("a", "x"), ("b", "y")], "model string, task string")
    got = sorted(tuple(r) for r in B.missing_cells(m, ["a", "b"], ["x", "y"]).collect())
    assert got == [("a", "y"), ("b", "x")]
