"""Operator 3: benchmark decontamination over a distributed positional inverted index.

Training documents are indexed in segments of bounded size: one row holds a block of whole
documents with every term's sorted positions (positions run through the segment, with a gap
between documents, so no phrase crosses two documents).  The index is a written table.

A test phrase is looked up segment by segment: the positions of its rarest term there, moved
back by that term's offset, are the candidate starts; the offset-adjusted lists of the other
terms, rarest first, are intersected with them.  With ``slop`` > 0 a term may stand up to that
many words from its place (proximity match); ``slop`` = 0 gives exact phrases.

The test side is taken in blocks of at most ``block_words`` words, each broadcast by itself, so
what is broadcast has a fixed bound whatever the benchmark's size.

Memory of a task has a bound too, however many documents it is given: a row of the index is
megabytes, so its writer closes a page and a row group by bytes after each row (Parquet waits for
100 rows otherwise, which is hundreds of them here), and a search holds a bounded number of windows
and candidate starts at a time.

Defined results: NULL and word-less texts have no words and match nothing; items shorter than
a window are one window; an item or document given twice counts as two rows; documents with
NULL ids are kept; an item with a NULL id is found and counted as any other, but has no name in
the digest; other columns play no part."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import (bound_batches, list_array, nonempty, scratch, table, to_bytes,
                                  released, word_hashes)

#: Words of one index segment (about 3 MB as a row, 15 MB in a worker while it is built).
SEGMENT_WORDS = 250_000
#: Words of test windows broadcast at a time (8 bytes each).
BLOCK_WORDS = 2_000_000
#: Free positions between documents, unless a window with its slop on both sides needs more.
GAP = 64
#: How the index is written: after each segment a page of 1 MB is closed, a row group of 16 MB.
INDEX_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(1 << 20),
                 "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Windows, and candidate starts (those of one window, if they are more), of a search at a time.
SEARCH_WINDOWS = 20_000
SEARCH_STARTS = 1 << 18

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and anything beyond ASCII."""
    return text.translate(_LOWER).split() if text else []


INDEX_SCHEMA = ("segment long, ids array<string>, n_words array<int>, starts array<int>, "
                "terms array<long>, term_starts array<int>, steps array<int>")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_words: int = SEGMENT_WORDS, gap: int = GAP) -> DataFrame:
    """The positional index of ``docs``, one row per segment.  ``steps`` holds the positions of
    all terms, term after term, as differences to the position before.  ``gap`` free positions
    keep documents apart; a search must not reach over them (window + 2 x slop)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, hashes, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                ids.append(doc)
                hashes.append(word_hashes(words, len(words)))
                held += len(words) + gap
                if held >= segment_words:
                    yield _segment(part << 32 | made, ids, hashes, gap)
                    ids, hashes, held, made = [], [], 0, made + 1
        if ids:
            yield _segment(part << 32 | made, ids, hashes, gap)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return scratch(rows.mapInArrow(released(run), INDEX_SCHEMA), "index", INDEX_OPTIONS)


def _segment(number: int, ids: list, hashes: list[np.ndarray], gap: int) -> pa.RecordBatch:
    sizes = np.array([len(h) for h in hashes], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    flat = np.concatenate(hashes)
    places = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
    order = np.argsort(flat, kind="stable")
    terms, first = np.unique(flat[order], return_index=True)
    steps = np.diff(places[order], prepend=0)

    def one(values, kind):
        return list_array(values, np.array([0, len(values)]), kind)

    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.string())), one(sizes, pa.int32()),
         one(starts, pa.int32()), one(terms.view(np.int64), pa.int64()),
         one(np.append(first, len(flat)), pa.int32()), one(steps, pa.int32())],
        names=["segment", "ids", "n_words", "starts", "terms", "term_starts", "steps"])


class Windows:
    """Test windows: term hashes (one row per window, unused places at the end), their lengths,
    and the name of the item each belongs to, by number."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        rows, named, lengths, numbers = [], [], [], {}
        for item, text in items:
            words = words_of(text)
            h = word_hashes(words, len(words))
            for i in range(max(len(h) - window, 0) + 1 if len(h) else 0):
                rows.append(np.pad(h[i: i + window], (0, max(0, window - len(h)))))
                lengths.append(min(window, len(h)))
                named.append(numbers.setdefault(item, len(numbers)))
        self.names, self.named = list(numbers), np.array(named, np.int64)
        self.terms = np.array(rows, np.uint64).reshape(len(rows), window)
        self.lengths = np.array(lengths, np.int64)


def _search(windows: Windows, terms: np.ndarray, first: np.ndarray, positions: np.ndarray,
            slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of all matches in one segment, in portions.  A match starts where the
    window's first word stands or, with slop, would stand as seen from the rarest term."""
    if not len(terms):
        return
    lists = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(first)) << 32 | positions  # sorted
    width = windows.terms.shape[1]
    for begin in range(0, len(windows.lengths), SEARCH_WINDOWS):
        wanted, lengths = (x[begin: begin + SEARCH_WINDOWS] for x in (windows.terms, windows.lengths))
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        used = np.arange(width) < lengths[:, None]
        found = (terms[at] == wanted) | ~used
        count = np.where(used, np.diff(first).astype(np.int64)[at], np.int64(1) << 62)
        alive = np.flatnonzero(found.all(axis=1))
        at, count, lengths = at[alive], count[alive], lengths[alive]
        order = np.argsort(count, axis=1, kind="stable")  # offsets, rarest term first
        rarest = order[:, 0]
        many = count[np.arange(len(alive)), rarest]
        ends = np.cumsum(many)
        low = 0
        while low < len(alive):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - many[low] + SEARCH_STARTS, side="right")))
            which = np.repeat(np.arange(low, high), many[low:high])
            within = np.arange(len(which)) - np.repeat(ends[low:high] - many[low:high] - (ends[low] - many[low]), many[low:high])
            start = positions[first[at[which, rarest[which]]] + within] - rarest[which]
            for k in range(1, width):
                offset = order[which, k]
                there = offset < lengths[which]
                key = (at[which, offset].astype(np.int64) << 32) + start + offset
                near = np.searchsorted(lists, key - slop)
                hit = lists[np.minimum(near, len(lists) - 1)]
                keep = ~there | (near < len(lists)) & (hit >= key - slop) & (hit <= key + slop)
                which, start = which[keep], start[keep]
            yield begin + alive[which], start
            low = high


def _merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches [low, high) of one document as one, sorted."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    base = doc * (1 << 33)  # documents apart, so one running maximum serves all
    reach = np.maximum.accumulate(base + high)
    new = np.r_[True, base[1:] + low[1:] > reach[:-1]] if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(doc) - 1] if len(at) else at
    return doc[at], low[at], (reach - base)[last]


MATCH_SCHEMA = "segment long, slot int, spans array<struct<start:int,end:int>>, items array<string>"


def match(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """(segment, slot, spans, items) of the documents in which a window occurs: the matched
    stretches of words [start, end), merged, and the items found."""
    sent = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            for i in range(batch.num_rows):
                sizes, starts, terms, first, steps = (batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                                                      for c in range(1, 6))
                w = sent.value
                hits, pairs = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
                for which, at in _search(w, terms.view(np.uint64), first, np.cumsum(steps, dtype=np.int64), slop):
                    if not len(which):
                        continue
                    doc = np.searchsorted(starts, at + slop, side="right") - 1
                    low = np.maximum(at - slop - starts[doc], 0)
                    high = np.minimum(at + w.lengths[which] + slop - starts[doc], sizes[doc])
                    hits = np.array(_merged(*np.concatenate([hits, [doc, low, high]], axis=1)))
                    pairs = np.union1d(pairs, doc << 32 | w.named[which])
                if not len(pairs):
                    continue
                found: dict[int, list] = {}
                for d, x in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
                    found.setdefault(d, []).append(w.names[x])
                spans: dict[int, list] = {}
                for d, a, b in zip(*hits.tolist(), strict=True):
                    spans.setdefault(d, []).append({"start": a, "end": b})
                slots = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(slots), pa.int64()), pa.array(slots, pa.int32()),
                     pa.array([spans[d] for d in slots],
                              pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array([sorted(found[d], key=lambda x: (x is None, x or "")) for d in slots], pa.list_(pa.string()))],
                    names=["segment", "slot", "spans", "items"])

    columns = index.select("segment", "n_words", "starts", "terms", "term_starts", "steps")
    return columns.mapInArrow(released(run), MATCH_SCHEMA)


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Windows]:
    """The test side in blocks of whole items of bounded size (the bound is on the windows'
    words; letters bound words from above)."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(letters * window / block_words))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for i in range(count):
        some = rows.filter(block == i) if count > 1 else rows
        yield Windows([(r["item"], r["text"].encode()) for r in some.collect() if r["text"]], window)


def find(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         block_words: int = BLOCK_WORDS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per document: id, n_words, the matched spans of words and the items found."""
    index = build_index(docs, id_col, text_col, segment_words, max(GAP, window + 2 * slop + 1))
    every = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("slot", "doc")).select(
        "segment", "slot", F.col("doc.ids").alias("id"), F.col("doc.n_words").alias("n_words"))
    parts = [match(index, w, slop) for w in _blocks(items, item_col, item_text_col, window, block_words)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    if len(parts) > 1:  # a document's matches of all blocks; as many rows as blocks at most
        hits = hits.groupBy("segment", "slot").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    kind = docs.schema[id_col].dataType.simpleString()
    return every.join(hits, ["segment", "slot"], "left").select(
        F.col("id").cast(kind).alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("spans", F.expr("array()")).alias("spans"),
        F.array_sort(F.coalesce("items", F.expr("array()"))).alias("items"))


def covered(spans: str) -> F.Column:
    """How many words the spans cover together."""
    return F.expr(f"""aggregate(array_sort({spans}), struct(0L AS n, 0 AS reach),
        (a, s) -> struct(a.n + greatest(s.end - greatest(s.start, a.reach), 0) AS n,
                         greatest(s.end, a.reach) AS reach), a -> a.n)""")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns, from exact phrase matches."""
    return find(docs, items).select(
        "doc_id", "n_words", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE: dict[str, str] = {}
