"""Waiting, shared budgets and durable progress of scoring jobs."""
import os
import time

import pytest
from pyspark.sql import functions as F

from evalspark.operators import pacing, progress, scoring
from evalspark.session import scratch_path
from evalspark.streaming.incremental import read_scored, run_incremental


class Clock:
    def __init__(self, now=1000.0):
        self.now, self.slept = now, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def impatient(folder, gap_s=0.05):
    """Refuses every call within ``gap_s`` of any other one, whichever process made it, by a
    file that all workers lock."""
    def build():
        import fcntl

        def predict(prompts):
            with open(os.path.join(folder, "last"), "a+") as f:
                fcntl.flock(f, fcntl.LOCK_EX)
                f.seek(0)
                last, now = float(f.read() or 0), time.time()
                f.truncate(0)
                f.write(str(now))
            if now - last < gap_s:
                raise pacing.Refused("too soon")
            return [p.upper() for p in prompts]
        return predict
    return build


def test_slots_of_the_lanes_never_meet():
    starts = []
    for lane in range(4):
        clock = Clock(1000 + 0.013 * lane)
        turns = pacing.Turns(pacing.RateLimit(10.0), lane, 4, clock, clock.sleep)
        for _ in range(25):
            turns.take(["x"])
            starts.append(clock.now)
            clock.now += 0.07 * lane  # the call itself
    starts.sort()
    assert min(b - a for a, b in zip(starts, starts[1:], strict=False)) >= 0.075


def test_a_late_lane_waits_for_its_next_slot():
    clock = Clock(1000.0)
    turns = pacing.Turns(pacing.RateLimit(1.0), 0, 2, clock, clock.sleep)
    assert turns.take(["x"]) == 0
    clock.now = 1002.2
    assert turns.take(["x"]) == 0  # within the first quarter of its slot
    clock.now = 1004.3
    assert turns.take(["x"]) == pytest.approx(1.7)


def test_tokens_are_shared_out():
    clock = Clock(0.0)
    limit = pacing.RateLimit(calls_per_s=100.0, tokens_per_s=10.0, tokens_of=len)
    turns = pacing.Turns(limit, 0, 2, clock, clock.sleep)
    turns.take(["a" * 20])  # 20 tokens at this lane's 5 a second
    before = clock.now
    turns.take(["b"])
    assert clock.now - before >= 4


@pytest.mark.parametrize("bad", [{"calls_per_s": 0}, {"calls_per_s": 1, "tokens_per_s": -1}])
def test_rates_must_be_positive(bad):
    with pytest.raises(ValueError):
        pacing.RateLimit(**bad)


def test_waits_grow_and_are_not_latency():
    clock, asked = Clock(), []

    def predict(prompts):
        asked.append(prompts)
        raise (pacing.Refused("slow down", retry_after=7) if len(asked) == 2 else ConnectionError("503"))

    scorer = scoring.Scorer(predict, max_attempts=4, retry=pacing.Retry(wait_s=3.0), sleep=clock.sleep)
    prediction, latency, attempts, _, status, error = scorer.one("p")
    assert clock.slept == [3.0, 7, 9.0] and attempts == 4 and (prediction, status) == ("error", "error")
    assert latency < 1 and error == "ConnectionError: 503"


def test_errors_that_no_wait_mends_end_the_attempts():
    def predict(prompts):
        raise PermissionError("401")

    scorer = scoring.Scorer(predict, retry=pacing.Retry(retryable=lambda e: "503" in str(e)), sleep=lambda s: None)
    assert scorer.one("p")[2] == 1


def test_default_waits_outlast_a_refusal_window(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id long, prompt string").coalesce(1)
    got = scoring.score(rows, impatient(str(tmp_path))).collect()
    assert {r["status"] for r in got} == {"ok"} and max(r["attempts"] for r in got) == 2
    assert max(r["latency_s"] for r in got) < 0.1


def test_all_tasks_share_one_budget(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(24)], "id long, prompt string")
    got = scoring.score(rows, impatient(str(tmp_path)), rate=pacing.RateLimit(calls_per_s=8.0), num_partitions=4).collect()
    assert {r["status"] for r in got} == {"ok"} and len(got) == 24
    assert sum(r["attempts"] for r in got) <= 26  # a machine under load may miss a slot now and then


def counting(folder, die_after=None):
    """Notes every prompt it is asked; the process dies after so many of them."""
    def build():
        def predict(prompts):
            noted = os.path.join(folder, "asked")
            with open(noted, "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            if die_after is not None and sum(1 for _ in open(noted)) > die_after:
                os._exit(1)
            return [p.upper() for p in prompts]
        return predict
    return build


def asked(folder):
    with open(os.path.join(folder, "asked")) as f:
        return f.read().split()


def test_a_killed_job_goes_on_where_it_stopped(spark, tmp_path):
    folder, rows = scratch_path(spark, "chunks"), [(i, f"p{i}") for i in range(100)]
    samples = spark.createDataFrame(rows, "id long, prompt string")
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    with pytest.raises(Exception):
        progress.score_durably(samples, counting(str(first), die_after=50), "id", folder, chunk_rows=10, num_partitions=1)
    held = {r["id"] for r in spark.read.parquet(folder).collect()}
    assert len(held) == 50 and len(asked(first)) == 51
    got = progress.score_durably(samples, counting(str(second)), "id", folder, chunk_rows=10, num_partitions=1)
    assert sorted(asked(second)) == sorted(p for i, p in rows if i not in held)  # once per remaining sample
    assert sorted((r["id"], r["prediction"]) for r in got.collect()) == [(i, p.upper()) for i, p in rows]


def test_a_task_run_again_skips_its_chunks(spark, tmp_path):
    """The same chunks met again without the key filter (as a repeated task does) call no model."""
    folder, samples = scratch_path(spark, "chunks"), spark.createDataFrame([(i, f"p{i}") for i in range(30)], "id long, prompt string")
    progress.score_durably(samples, counting(str(tmp_path)), "id", folder, chunk_rows=7, num_partitions=3)
    calls, plain = len(asked(tmp_path)), progress.without_scored
    try:
        progress.without_scored = lambda samples, scored, keys: samples
        progress.score_durably(samples, counting(str(tmp_path)), "id", folder, chunk_rows=7, num_partitions=3)
    finally:
        progress.without_scored = plain
    assert len(asked(tmp_path)) == calls == 30 and spark.read.parquet(folder).count() == 30
    ledger = progress.read_ledger(spark, folder).groupBy("scored").agg(F.sum("n_rows").alias("n")).collect()
    assert {r["scored"]: r["n"] for r in ledger} == {True: 30, False: 30}


def test_keys_nulls_repeats_and_types(spark):
    rows = [(None, 1, "x", 2**60 + 1), (None, 1, "x", 2**60 + 1), (5, 1, None, None), (5, 2, "b", 7), (5, 2, "a", 8)]
    samples = spark.createDataFrame(rows, "a long, b int, prompt string, extra long")
    folder = scratch_path(spark, "chunks")
    for _ in range(2):
        got = progress.score_durably(samples, lambda: lambda ps: [p + "!" for p in ps], ["a", "b"], folder)
        assert sorted(((r["a"] or 0), r["b"], r["prediction"], r["extra"] or 0) for r in got.collect()) == [
            (0, 1, "x!", 2**60 + 1), (5, 1, "!", 0), (5, 2, "a!", 8)]


def test_nothing_to_score(spark):
    empty = spark.createDataFrame([], "id long, prompt string")
    assert progress.score_durably(empty, lambda: lambda ps: ps, "id", scratch_path(spark, "chunks")).count() == 0


def test_stream_scores_redelivered_samples_once(spark, tmp_path):
    src, sink, ck = (scratch_path(spark, x) for x in ("src", "sink", "ck"))
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id long, prompt string")
    for delivered in ("id < 10", "id < 10", "id >= 5"):
        prompts.where(delivered).write.mode("append").parquet(src)
        run_incremental(spark, src, prompts.schema, sink, ck, counting(str(tmp_path)), key="id", max_files_per_trigger=1)
    assert sorted(asked(tmp_path)) == sorted(f"p{i}" for i in range(20))
    assert read_scored(spark, sink).count() == 20
    # a sink that is ahead of the stream's checkpoint (a batch replayed after a failure)
    run_incremental(spark, src, prompts.schema, sink, scratch_path(spark, "ck"), counting(str(tmp_path)), key="id")
    assert len(asked(tmp_path)) == 20
