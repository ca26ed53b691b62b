"""Run search, chat templates, key bitmap, block-wise paired tests, scorecard levels, raw lines."""
import math
import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from evalspark.operators import chat, metrics, prepare, stats
from evalspark.plans.scorecard import scorecard, scorecard_levels
from evalspark.session import scratch_path
from evalspark.sources import runs, text_label


# ---- S2
def test_lines_keep_every_character(spark, tmp_path):
    path = tmp_path / "lines.txt"
    lines = ["good news\x01 and more@positive", "\x00starts with nul@neutral", 'quo"te,\\ back@negative', "é ÿ \xa0@positive", "", "no mark"]
    path.write_bytes("\r\n".join(lines).encode("latin-1") + b"\r\n")
    assert [r["value"] for r in text_label.read_lines(spark, str(path)).collect()] == lines
    assert text_label.read_labelled_text(spark, str(path)).count() == 4


def test_written_lines_come_back(spark):
    lines = ["a\x01b", "\x00", '"', "ÿ", "x\ry", "", "日👍z"]
    path = scratch_path(spark, "lines")
    frame = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    text_label.write_lines(frame, "line", path)
    assert [r["value"] for r in text_label.read_lines(spark, path).collect()] == [*lines[:-1], "??z"]


# ---- S4
@pytest.fixture(scope="module")
def store(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"r{i:03d}", f"e{i % 4}", start + timedelta(days=i), "train" if i % 3 else "bench", None if i % 10 == 0 else float(i * 7 % 50),
             f"m{i % 5}") for i in range(200)]
    frame = spark.createDataFrame(rows, "id string, exp string, at timestamp, phase string, acc double, model string")
    rec = runs.run_records(frame, "exp", "id", "at", tags={"phase": "phase", "model": "model"}, metrics={"acc": "acc"})
    path = scratch_path(spark, "runs")
    for low in range(0, 200, 50):
        runs.append_runs(rec.where(f"run_id >= 'r{low:03d}' AND run_id < 'r{low + 50:03d}'").coalesce(1), path)
    return path, rows


def test_search_in_order_with_limit(spark, store):
    path, rows = store
    got = runs.search_runs(spark, path, experiments=["e1", "e2"], phase="train", tags={"model": "m3"},
                           since=datetime(2024, 1, 10), until=datetime(2024, 6, 1), order_by=["metrics.acc DESC"], max_results=4)
    want = [r for r in rows if r[1] in ("e1", "e2") and r[3] == "train" and r[5] == "m3" and datetime(2024, 1, 10) <= r[2] < datetime(2024, 6, 1)]
    want.sort(key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))
    assert [r["run_id"] for r in got.collect()] == [r[0] for r in want[:4]]


def test_search_per_experiment(spark, store):
    path, rows = store
    got = runs.search_runs(spark, path, order_by=["tags.model", "start_time desc"], max_results=3, per_experiment=True).collect()
    want = {e: sorted((r for r in rows if r[1] == e), key=lambda r: (r[5], -r[2].timestamp()))[:3] for e in ("e0", "e1", "e2", "e3")}
    assert {(r["experiment"], r["run_id"]) for r in got} == {(e, r[0]) for e, x in want.items() for r in x}


def test_search_opens_only_the_files_it_needs(spark, store):
    path, _ = store
    found = runs.search_runs(spark, path, experiments=["e1"], phase="bench", since=datetime(2024, 2, 1))
    files = {r["f"] for r in found.select(F.input_file_name().alias("f")).collect()}
    assert files and all("/experiment=e1/" in f for f in files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment" in plan or "PartitionFilters: [(experiment" in plan
    assert "EqualTo(phase,bench)" in plan and "GreaterThanOrEqual(start_time" in plan
    limited = runs.search_runs(spark, path, order_by=["metrics.acc DESC"], max_results=3)
    assert "TakeOrderedAndProject" in limited._jdf.queryExecution().executedPlan().toString()
    each = runs.search_runs(spark, path, max_results=3, per_experiment=True)
    assert "WindowGroupLimit" in each._jdf.queryExecution().executedPlan().toString()


def test_search_refuses_odd_orders(spark, store):
    with pytest.raises(ValueError, match="order"):
        runs.search_runs(spark, store[0], order_by=["start_time; drop"])


# ---- P12
def test_template_texts(spark):
    row = spark.range(1).select(chat.compile_text("{{{a|trim|upper}}} {b}", {"a": F.lit("  x "), "b": F.lit(None)}).alias("t")).first()
    assert row["t"] == "{X} "
    for bad in ("{c}", "{a|nope}", "{", "a}"):
        with pytest.raises(ValueError):
            chat.compile_text(bad, {"a": F.lit("")})


def render(turns, system, turn, opening, generation):
    """A conversation by plain string work."""
    first = ""
    if turns and turns[0][0] == "system":
        first, turns = (turns[0][1] or "").strip(), turns[1:]
    return opening + first + system + "".join(turn.format(r, (t or "").strip()) for r, t in turns) + generation


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_segments_make_up_the_chat(spark, block):
    conversations = {1: [("system", " Be brief. "), ("user", "hi\n"), ("assistant", "yo")], 2: [("user", " q "), ("system", "late")],
                     3: [("system", None)], 4: [("user", None), ("assistant", "x " * 50)], None: [("user", "no id")]}
    rows = [(c, 10 * k - 7, r, t) for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.render_segments(conv, chat.HEADER_IDS, add_generation_prompt=True, block=block).collect()
    assert len(got) == len(rows)
    head = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"
    for c, turns in conversations.items():
        mine = sorted((r["offset"], r["segment"]) for r in got if r["conv_id"] == c)
        text, at = "", 0
        for offset, segment in mine:
            assert offset == at
            text, at = text + segment, at + len(segment)
        want = render(turns, "<|eot_id|>", "<|start_header_id|>{}<|end_header_id|>\n\n{}<|eot_id|>", head,
                      "<|start_header_id|>assistant<|end_header_id|>\n\n")
        assert text == want


# ---- P11
@pytest.mark.parametrize("bits", [6, 10, 24])
def test_key_bitmap_changes_no_count(spark, bits):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices("abcd", k=60))) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(rnd.choices("abcd", k=12))) for i in range(20)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["n_shared_ngrams"]) for r in prepare.ngram_overlap(docs, bench, n=4, filter_bits=bits).collect()}
    grams = lambda t: {tuple(t.split()[k: k + 4]) for k in range(len(t.split()) - 3)}
    items, want = [grams(r["text"]) for r in bench.collect()], {}
    for r in docs.collect():
        mine = grams(r["text"])
        if n := sum(bool(mine & x) for x in items):
            want[r["doc_id"]] = (n, len(set().union(*(mine & x for x in items))))
    assert got == want


def test_only_candidates_leave_the_scan(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(50)], "doc_id long, text string")
    bench = docs.where("doc_id = 7").withColumnRenamed("doc_id", "item_id")
    keys = prepare._gram_keys(docs, "doc_id", "text", 8)
    found = prepare.key_filter(prepare._gram_keys(bench, "item_id", "text", 8).select("k1", "k2"), 20)
    assert keys.where(prepare.may_hold(found, 20)).count() == 93 < keys.count() == 93 * 50
    empty = prepare.key_filter(keys.limit(0).select("k1", "k2"), 8)
    assert keys.where(prepare.may_hold(empty, 8)).count() == 0


# ---- T1, T2, T4
def brute_pairs(rows, candidates):
    scores = {}
    for m, u, x in rows:
        if x is not None:
            scores.setdefault((m, u), []).append(x)
    mean = {k: sum(v) / len(v) for k, v in scores.items()}
    models, units = sorted({m for m, _ in mean}), sorted({u for _, u in mean})
    out = {}
    for c, b in product([m for m in models if m in candidates], [m for m in models if m not in candidates]):
        both = [(mean[c, u], mean[b, u]) for u in units if (c, u) in mean and (b, u) in mean]
        if both:
            d = [x - y for x, y in both]
            n, m = len(d), sum(x - y for x, y in both) / len(d)
            out[c, b] = (n, sum(x for x, _ in both) / n, sum(y for _, y in both) / n, m,
                         math.sqrt(sum((x - m) ** 2 for x in d) / (n - 1)) if n > 1 else None)
    return out


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_paired_sums_in_blocks(spark, monkeypatch, block):
    rnd = random.Random(block)
    rows = [(f"m{m}", f"u{u}", rnd.random() + 1e6 * (m == 2)) for m in range(6) for u in range(40) if rnd.random() < 0.7 for _ in range(1 + (u % 2))]
    rows += [("m0", "u1", None), ("m9", "only here", 1.0), ("same", "u0", 0.3), ("twin", "u0", 0.1)]
    rows += [(m, f"k{k}", 0.1 * k + (0.5 if m == "m1" else 0.25)) for k in range(30) for m in ("m1", "m3")]
    frame = spark.createDataFrame(rows, "model string, unit string, score double").repartition(5)
    monkeypatch.setattr(stats, "BLOCK_UNITS", block)
    got = {(r["slm"], r["llm_baseline"]): r for r in stats.pair_stats(frame, F.col("model").isin("m0", "m1", "same")).collect()}
    want = brute_pairs(rows, {"m0", "m1", "same"})
    assert got.keys() == want.keys()
    for k, (n, x, y, d, sd) in want.items():
        r = got[k]
        assert r["n_pairs"] == n and r["mean_difference"] == pytest.approx(d, rel=1e-9, abs=1e-12)
        assert (r["slm_mean_accuracy"], r["llm_mean_accuracy"]) == (pytest.approx(x), pytest.approx(y))
        assert r["sd_difference"] == (None if sd is None else pytest.approx(sd, rel=1e-6, abs=1e-9))


def test_constant_differences_have_no_deviation(spark):
    rows = [(m, f"u{u}", 0.5 * u + (1.5 if m == "a" else 0.0)) for u in range(500) for m in "ab"]
    frame = spark.createDataFrame(rows, "model string, unit string, score double").repartition(7)
    r = stats.paired_t(frame, F.col("model") == "a").first()
    assert (r["n_pairs"], r["mean_difference"], r["sd_difference"], r["t_statistic"]) == (500, 1.5, 0.0, None)


def test_many_models_send_one_row_per_pair_and_task(spark):
    frame = spark.range(40 * 3000).select((F.col("id") % 40).cast("string").alias("model"), F.floor(F.col("id") / 40).alias("unit"),
                                          F.rand(5).alias("score"))
    got = stats.pair_grid(frame, F.col("model").cast("int") < 20)
    rows = got.collect()
    assert len(rows) == 400 and {r["n_units"] for r in rows} == {3000}


def test_one_tail_formula_for_all_degrees_of_freedom():
    """Against the finite sums for whole degrees of freedom, and the normal limit."""
    def finite(t, n):
        a, c2 = math.atan(abs(t) / math.sqrt(n)), 1 / (1 + t * t / n)
        if n % 2:
            s, term = 0.0, 1.0
            for k in range(1, (n - 1) // 2 + 1):
                s, term = s + term, term * 2 * k / (2 * k + 1) * c2
            return 1 - 2 / math.pi * (a + math.sin(a) * math.cos(a) * s)
        s, term = 0.0, 1.0
        for k in range(1, n // 2 + 1):
            s, term = s + term, term * (2 * k - 1) / (2 * k) * c2
        return 1 - math.sin(a) * s

    for n in (1, 2, 3, 4, 5, 9, 30, 101, 1000, 20001):
        for t in (0.0, 1e-6, 0.3, 1.0, 1.96, 4.0, 9.0):
            assert stats.t_two_sided_p(t, n) == pytest.approx(finite(t, n), abs=2e-12)
    for t in (0.5, 1.96, 5.0):
        assert stats.t_two_sided_p(t, 1e12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-8)
    assert stats.t_two_sided_p(40.0, 50.0) == pytest.approx(0.0, abs=1e-12) and stats.t_two_sided_p(2.0, 4.5) < stats.t_two_sided_p(2.0, 4.0)


# ---- M17
def test_latency_is_the_mean_over_solutions(spark):
    rows = [("m", 1, 1, 0.1), ("m", 1, 0, 0.3), ("m", 1, 0, 0.5), ("m", 2, 1, 2.0), ("n", 1, 0, None), ("n", 1, 1, 1.0)]
    gens = spark.createDataFrame(rows, "model string, problem_id int, passed int, latency_s double")
    got = {(r["model"], r["problem_id"]): (r["score"], r["latency_s"]) for r in metrics.problem_scores(gens).collect()}
    assert got == {("m", 1): (1 / 3, 0.3), ("m", 2): (1.0, 2.0), ("n", 1): (0.5, 1.0)}
    card = scorecard(metrics.problem_scores(gens).withColumn("task", F.lit("code_generation")).where("model = 'm'")).first()
    assert (card["latency_ms"], card["accuracy"]) == (1150.0, 0.6667)  # mean of 300 ms and 2000 ms


def test_levels(spark):
    rows = [("a", "x", 1.0, 0.1), ("a", "y", 0.0, 0.3), ("b", "x", 1.0, 0.2), (None, "x", 0.5, 1.0)]
    got = scorecard_levels(spark.createDataFrame(rows, "model string, task string, score double, latency_s double")).collect()
    assert {(r["level"], r["model"], r["task"]): (r["n_samples"], r["accuracy"], r["latency_ms"]) for r in got} == {
        ("model, task", "a", "x"): (1, 1.0, 100.0), ("model, task", "a", "y"): (1, 0.0, 300.0), ("model, task", "b", "x"): (1, 1.0, 200.0),
        ("model, task", None, "x"): (1, 0.5, 1000.0), ("model", "a", None): (2, 0.5, 200.0), ("model", "b", None): (1, 1.0, 200.0),
        ("model", None, None): (1, 0.5, 1000.0), ("task", None, "x"): (3, 0.8333, 433.33), ("task", None, "y"): (1, 0.0, 300.0),
        ("total", None, None): (4, 0.625, 400.0)}
