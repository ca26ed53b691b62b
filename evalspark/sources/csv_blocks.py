"""CSV with multi-line values, read in blocks (S1 for logs).

Spark's own multi-line CSV reader keeps a file in one task.  Here the text source cuts files at
line ends into blocks, wherever its splits fall, and quotes decide which line ends are record
ends:

1. Each task notes for its blocks how they end - inside a quoted value or not - for both ways
   they may begin, and the header of files that begin in it.  One small row a block.
2. Followed through a file, these notes give how each block really begins.  Only the blocks that
   begin inside a value are sent to the tasks (8 bytes each), with the header number of each file.
3. Each task parses the records that begin and end in a block.  Pieces of records that cross
   block ends are put together by a shuffle of those pieces alone.

Values are NULL if empty, '' if written as ``""``; doubled quotes are one; text behind a closing
quote belongs to the value; missing values are NULL, surplus ones dropped; blank lines are no
records; a carriage return before a record's end is not part of it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.session import scratch_path

_FIELD = re.compile(r'(?:"((?:[^"]++|"")*+)"([^,]*)|([^,]*))(,|\Z)', re.S)


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a value is still open at the line's end, if the line begins inside one or not."""
    at, n = 0, len(line)
    while True:
        if quoted:
            at = line.find('"', at)
            while at >= 0 and line.startswith('""', at):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at += 1
        elif line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        quoted, at = False, line.find(",", at) + 1
        if at == 0 or at > n:
            return False


def parse_record(text: str) -> list[str | None]:
    """The values of one record."""
    text = text.removesuffix("\r")
    if '"' not in text:
        return [v or None for v in text.split(",")]
    out: list[str | None] = []
    at = 0
    while True:
        m = _FIELD.match(text, at)
        inner, behind, plain, mark = m.groups()
        out.append(plain or None if inner is None else inner.replace('""', '"') + behind)
        if not mark:
            return out
        at = m.end()


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, start, value): lines in file order, with their file and the place of their block."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, start, lines) for each run of lines of one block in each batch."""
    for batch in batches:
        files, starts = (batch.column(i).to_numpy() for i in (0, 1))
        if len(files):
            edges = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            for low, high in zip([0, *edges], [*edges, len(files)], strict=True):
                yield int(files[low]), int(starts[low]), batch.column(2).slice(low, high - low)


def _note_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def note() -> pa.RecordBatch:
        if opened and head is not None:
            raise ValueError(f"a header goes on beyond its first block: {head[:80]!r}")
        return pa.RecordBatch.from_pydict(
            {"file": [here[0]], "start": [here[1]], "if_plain": [ends[0]], "if_quoted": [ends[1]], "header": [head]},
            schema=pa.schema([("file", pa.int64()), ("start", pa.int64()), ("if_plain", pa.bool_()),
                              ("if_quoted", pa.bool_()), ("header", pa.string())]))

    here, ends, head, opened = None, [False, True], None, False
    for file, start, lines in _block_runs(batches):
        if here != (file, start):
            if here:
                yield note()
            here, ends, head, opened = (file, start), [False, True], None, start == 0
        i = 0
        while opened and i < len(lines):  # the header may run over several lines
            line = lines[i].as_py()
            head = line.removeprefix("﻿") if head is None else f"{head}\n{line}"
            if head in ("", "\r"):
                head = None
            opened = head is None or ends_quoted(head, False)
            i += 1
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            ends = [ends_quoted(line, e) for e in ends]
    if here:
        yield note()


class _Layout:
    """What the notes say: blocks that begin inside a value, and each file's header number."""

    def __init__(self, spark: SparkSession, paths: str | list[str]):
        folder = scratch_path(spark, "csv-blocks")
        _lines(spark, paths).mapInArrow(
            _note_blocks, "file long, start long, if_plain boolean, if_quoted boolean, header string").write.parquet(folder)
        notes = spark.read.parquet(folder)
        self.headers = [r["header"] for r in notes.select("header").where("header IS NOT NULL").distinct().orderBy("header").collect()]
        number = {h: i for i, h in enumerate(self.headers)}
        known = notes.select("file", "start", "if_plain", "if_quoted", F.xxhash64("header").alias("h"))
        hashes = {r["h"]: number[r["header"]] for r in notes.where("header IS NOT NULL").select(
            "header", F.xxhash64("header").alias("h")).distinct().collect()}
        inside, self.cross, file_header = [], False, {}
        file, quoted = None, False
        for r in known.orderBy("file", "start").toLocalIterator():  # one row a block
            if r["file"] != file:
                file, quoted = r["file"], False
            if r["start"] == 0 and r["h"] in hashes:
                file_header[file] = hashes[r["h"]]
            if quoted:
                inside.append((file, r["start"]))
            quoted = r["if_quoted"] if quoted else r["if_plain"]
            self.cross = self.cross or quoted
        self.inside = np.sort(np.array([_block_key(*x) for x in inside], np.uint64))
        order = sorted(file_header)
        self.files, self.header_of = np.array(order, np.int64), np.array([file_header[f] for f in order], np.int32)

    def begins_inside(self, file: int, start: int) -> bool:
        key = np.uint64(_block_key(file, start))
        at = np.searchsorted(self.inside, key)
        return at < len(self.inside) and self.inside[at] == key

    def header(self, file: int) -> int:
        """The number of the file's header, -1 for a file without one."""
        at = np.searchsorted(self.files, file)
        return int(self.header_of[at]) if at < len(self.files) and self.files[at] == file else -1


def _block_key(file: int, start: int) -> int:
    return (file * 0x9E3779B97F4A7C15 + start) % 2**64


def _pieces(batches: Iterator[pa.RecordBatch], layout: _Layout) -> Iterator[tuple[int, int, str, str]]:
    """(file, start, kind, text): whole records, and of records that cross block ends the piece
    that opens them (head), that fills a block (body) or that ends them (tail)."""
    here, kind, held, quoted = None, "whole", [], False

    def rest() -> Iterator[tuple[int, int, str, str]]:
        if held:
            yield *here, "head" if kind == "whole" else "body", "\n".join(held)

    for file, start, lines in _block_runs(batches):
        first = here != (file, start)
        if first:
            if here:
                yield from rest()
            here, held = (file, start), []
            quoted = layout.begins_inside(file, start)
            kind = "tail" if quoted else "whole"
        marked = pc.match_substring(lines, '"').to_pylist()
        for line, has_quotes in zip(lines.to_pylist(), marked, strict=True):
            if has_quotes:
                quoted = ends_quoted(line, quoted)
            if quoted:
                held.append(line)
            elif held or kind == "tail":
                yield file, start, kind, "\n".join([*held, line])
                held, kind = [], "whole"
            elif line and line != "\r":
                yield file, start, kind, line
    if here:
        yield from rest()


class _Columns:
    """Parsed records of any header as one batch of all columns."""

    def __init__(self, headers: list[list[str]], columns: list[str]):
        self.columns = columns
        self.places = [[h.index(c) if c in h else -1 for c in columns] for h in headers]

    def batch(self, records: list[tuple[int, list]]) -> pa.RecordBatch:
        rows = []
        for header, values in records:
            n = len(values)
            rows.append([values[p] if 0 <= p < n else None for p in self.places[header]])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=self.columns)


def read_csv_blocks(spark: SparkSession, paths: str | list[str], batch_rows: int = 5000) -> DataFrame:
    """All records of all files as string columns: the columns of every header, in the order in
    which they come; a file lacks the columns that its header lacks.  One small job runs first."""
    layout = _Layout(spark, paths)
    headers = [[c or f"_c{i}" for i, c in enumerate(parse_record(h))] for h in layout.headers]
    columns = list(dict.fromkeys(c for h in headers for c in h))
    if not columns:
        raise ValueError(f"no file with a header under {paths}")
    shared = spark.sparkContext.broadcast(layout)  # 8 bytes a block that begins inside a value, 12 a file
    make, titles = _Columns(headers, columns), layout.headers
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)

    piece_schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("kind", pa.string()), ("header", pa.int32()),
                              ("text", pa.string())])

    def parsed(records: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        held = []
        for header, text in records:
            held.append((header, parse_record(text)))
            if len(held) == batch_rows:
                yield make.batch(held)
                held = []
        if held:
            yield make.batch(held)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple[int, str]]:
            waiting: set[int] = set()  # files whose header line is still to come
            seen = None
            for file, start, kind, text in _pieces(batches, shared.value):
                number = shared.value.header(file)
                if seen != (file, start):
                    seen = (file, start)
                    waiting = {file} if start == 0 else set()
                if kind == "whole" and number >= 0 and not (file in waiting and text.removeprefix("﻿") == titles[number]):
                    yield number, text
                waiting.discard(file)

        yield from parsed(whole())

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, kind, text in _pieces(batches, shared.value):
            if kind != "whole" and (number := shared.value.header(file)) >= 0:
                yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "kind": kind, "header": number, "text": text}],
                                                 schema=piece_schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from parsed((h, t) for b in batches for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    out = _lines(spark, paths).mapInArrow(records, schema)
    if layout.cross:
        pieces = _lines(spark, paths).mapInArrow(crossing, "file long, start long, kind string, header int, text string")
        # in a block the tail of the record before comes first
        order = Window.partitionBy("file").orderBy("start", F.col("kind") == "head")
        numbered = pieces.withColumn("record", F.count_if(F.col("kind") == "head").over(order))
        whole = numbered.groupBy("file", "record").agg(
            F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
        texts = whole.select("header", F.array_join(F.col("parts.text"), "\n").alias("text"))
        out = out.unionByName(texts.mapInArrow(joined, schema))
    return out
