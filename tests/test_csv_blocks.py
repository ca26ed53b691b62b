"""Multi-line CSV read in blocks of any size."""
import csv
import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.sources import csv_blocks
from evalspark.sources import prediction_logs as PL


@pytest.fixture
def small_blocks(spark):
    """Splits of a few bytes, so that most records cross block ends."""
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(path, header, rows, end="\n", quote=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=quote)
        out.writerow(header)
        out.writerows(rows)


def read(spark, path):
    frame = csv_blocks.read_csv_blocks(spark, str(path))
    return frame.columns, sorted(tuple(v or "" for v in r) for r in frame.collect())


ROWS = [(str(i), ['plain', 'a "quoted" word', "two\nlines", 'comma, and "quote"\nand a line\n\nblank above', '"', "é" * 30, " blanks ",
                  "x" * 200][i % 8], "" if i % 5 == 0 else f"v{i}") for i in range(44)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quote", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_records_that_cross_blocks(spark, small_blocks, tmp_path, end, quote):
    folder = tmp_path / "log"
    folder.mkdir()
    write(folder / "a.csv", ["id", "text", "v"], ROWS[:40], end, quote)
    write(folder / "b.csv", ["id", "text", "v"], ROWS[40:], end, quote)
    assert read(spark, folder) == (["id", "text", "v"], sorted(ROWS))


def test_generations_of_headers(spark, small_blocks, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for i in range(12):
        header = ["id", "m_pred", "m_latency"] if i % 2 else ["id", "m_pred", "m_correct", "m_latency_s"]
        write(folder / f"{i}.csv", header, [[f"{i}-{k}", f"text\n{k}", *"12"[: len(header) - 2]] for k in range(5)])
    (folder / "empty.csv").write_text("")
    columns, rows = read(spark, folder)
    assert sorted(columns) == ["id", "m_correct", "m_latency", "m_latency_s", "m_pred"] and len(rows) == 60
    long = PL.wide_to_long_predictions(PL.read_wide_log(spark, str(folder)), {"m": "m"}, id_cols=("id",), keep=())
    assert long.where("latency_s IS NULL").count() == 0 and long.where("correct IS NULL").count() == 30


def test_details(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('﻿"id","a,b",c\r\n1,,""\n\n2,"x ""y""" z,te"xt\r\n3,only\n4,1,2,surplus\n5,"open\nto the end', encoding="utf-8")
    frame = csv_blocks.read_csv_blocks(spark, str(path))
    assert frame.columns == ["id", "a,b", "c"]
    got = {r[0]: tuple(r[1:]) for r in frame.collect()}
    assert got == {"1": (None, ""), "2": ('x "y" z', 'te"xt'), "3": ("only", None), "4": ("1", "2"), "5": ('"open\nto the end', None)}


def test_no_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        csv_blocks.read_csv_blocks(spark, str(tmp_path))


def test_many_files_need_few_jobs(spark, tmp_path):
    for i in range(60):
        write(tmp_path / f"{i}.csv", ["id", "x"], [[str(i), "a\nb"]])
    group = "csv-blocks-jobs"
    spark.sparkContext.setJobGroup(group, "reading many logs")
    frame = csv_blocks.read_csv_blocks(spark, str(tmp_path))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 12 and frame.count() == 60


VALUE = st.text(st.sampled_from('ab",\n'), max_size=6)


@given(st.lists(st.tuples(VALUE, VALUE), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_line_states_and_values_agree_with_the_csv_module(rows):
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows(rows)
    text, records, held, quoted = buffer.getvalue(), [], [], False
    for line in text[:-1].split("\n"):
        quoted = csv_blocks.ends_quoted(line, quoted)
        held.append(line)
        if not quoted:
            records.append("\n".join(held))
            held = []
    assert not held
    assert [tuple(v or "" for v in csv_blocks.parse_record(r)) for r in records] == rows


@pytest.mark.parametrize(("text", "size"), [('a"a,\n"a\n"",a"\n,"', 9), ('"\n"\n"a\n\n,"",\n"a', 6), ('""a"\n,a\n"a,"\n"\n', 11)])
def test_any_text_gives_the_same_rows_in_any_blocks(spark, tmp_path, text, size):
    """Malformed quotes included: one block or many, the rows are the same."""
    path = tmp_path / "any.csv"
    path.write_text("h1,h2,h3\n" + text)
    got = []
    for block in (1 << 20, size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got.append(sorted(map(str, csv_blocks.read_csv_blocks(spark, str(path)).collect())))
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")
    assert got[0] == got[1]
    assert os.path.exists(path)
