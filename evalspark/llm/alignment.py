"""Operator 11: alignment of two tokenizers over the same texts.

Tasks take the texts in blocks of bounded size and stay in Arrow: token ids are list columns,
flattened with their parent indices; byte ends are cumulative sums that start anew with every
document; an Acero hash join on (document, end) finds the ends that both tokenizations share,
which cut a text into groups; linked id pairs (tokens whose byte ranges overlap) are counted by
``Table.group_by``.  Spark merges the partial counts of the blocks into corpus-wide document
counts, joins them to the pairs of each block (not of each document), and brings block and
counts together once more, where the figures of a document are sums over its links.

Defined results: a document without text (NULL or empty), or with a text whose joined token
bytes differ from a space and the text under either tokenizer, has no tokens: zeros and ''.
Rows that repeat an id are documents of their own; NULL ids stay NULL; other columns play no
part.  A block holds ``BLOCK_LETTERS`` bytes of text at most, or one longer text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.bpe import byte_characters
from evalspark.llm.common import bound_batches, nonempty, scratch, table

#: Bytes of text that one worker aligns at a time.
BLOCK_LETTERS = 1_000_000


class Tokenizer(NamedTuple):
    """Token ids of whole texts, and the bytes that each id stands for."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: pa.Array


def byte_level_tokenizer(spec: bytes, pattern: str) -> Tokenizer:
    """A byte-level BPE read from its JSON description; texts are encoded behind one space.
    Ids must follow the order of the merges, so that the lowest id is the merge to make first."""
    import tiktoken

    described = json.loads(spec)
    splitter = described.get("pre_tokenizer") or {}
    if described.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
        raise ValueError("only byte-level BPE without a normaliser and without a prefix space of its own")
    ids = described["model"]["vocab"]
    special = {t["content"] for t in described["added_tokens"] if t["special"]}
    made = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in described["model"]["merges"]]
    if made != sorted(set(made)):
        raise ValueError("ids do not follow the order of the merges")
    value = {c: b for b, c in enumerate(byte_characters())}
    entries = {i: bytes(value[c] for c in piece) for piece, i in ids.items() if piece not in special}
    ranks = {entry: i for i, entry in entries.items()}
    encoding = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = pa.array([entries.get(i) for i in range(max(entries) + 1)], pa.binary())
    return Tokenizer(lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], pieces)


def piece_tokenizer(model: bytes) -> Tokenizer:
    """A sentencepiece model, which puts a space before a text by itself."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)

    def as_bytes(i: int) -> bytes:
        piece = processor.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode()

    pieces = pa.array(map(as_bytes, range(processor.get_piece_size())), pa.binary())
    return Tokenizer(lambda texts: processor.encode(texts, num_threads=1), pieces)


class _Tokens:
    """The tokens of a block's documents as flat Arrow arrays: ids, parents (document) and ends."""

    def __init__(self, lists: list[list[int]], tokenizer: Tokenizer):
        self.offsets = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=self.offsets[1:])
        flat = np.fromiter(chain.from_iterable(lists), np.int32, self.offsets[-1])
        column = pa.LargeListArray.from_arrays(pa.array(self.offsets), pa.array(flat))
        self.ids = pc.list_flatten(column)
        self.parents = pc.list_parent_indices(column)
        self.bytes = tokenizer.pieces.take(self.ids)

    def joined(self) -> pa.Array:
        """The bytes of each document's tokens, one after the other."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), self.bytes), b"")

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each token ends in its document (a segmented cumulative sum) and in the block."""
        in_block = pc.cumulative_sum(pc.binary_length(self.bytes).cast(pa.int64())).to_numpy()
        before = np.r_[np.int64(0), in_block][self.offsets[:-1]]
        return in_block - before[self.parents.to_numpy()], in_block


def _shared_ends(a: _Tokens, b: _Tokens, a_ends: np.ndarray, b_ends: np.ndarray) -> pa.Table:
    """(doc, end) of the byte offsets where tokens of both kinds end."""
    left = pa.table({"doc": a.parents, "end": a_ends})
    right = pa.table({"doc": b.parents, "end": b_ends})
    return left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False).sort_by(
        [("doc", "ascending"), ("end", "ascending")])


def _group_texts(a: _Tokens, b: _Tokens, a_group: np.ndarray, b_group: np.ndarray, written: pa.Array) -> pa.Array:
    """`a1,a2|b1;a3|b2` of each document, with one mark too many at its end.  ``written`` holds
    each id followed by a comma, a bar and a semicolon, at three times the id."""
    a_last = np.r_[a_group[1:] != a_group[:-1], True]
    b_last = np.r_[b_group[1:] != b_group[:-1], True]
    out = np.empty(len(a_group) + len(b_group), np.int32)
    out[np.arange(len(a_group)) + np.searchsorted(b_group, a_group, "left")] = a.ids.to_numpy() * 3 + a_last
    out[np.arange(len(b_group)) + np.searchsorted(a_group, b_group, "right")] = b.ids.to_numpy() * 3 + 2 * b_last
    offsets = pa.array(a.offsets + b.offsets, pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, written.take(pa.array(out))), "")


def _links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of every overlapping pair (ends within the block)."""
    first = np.searchsorted(b_ends, np.r_[np.int64(0), a_ends[:-1]], "right")
    count = np.searchsorted(b_ends, a_ends, "left") - first + 1
    start = np.cumsum(count) - count
    a = np.repeat(np.arange(len(a_ends)), count)
    return a, np.arange(len(a)) - start[a] + first[a]


def align_block(texts: pa.Array, a: Tokenizer, b: Tokenizer, written: pa.Array, keep_groups: bool = False) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups (or their sha-256), pair and times, a row per text.
    ``pair`` lists the distinct linked pairs of ids (the A id in the high half), ``times`` how
    many links each of them has in the document."""
    n = len(texts)
    held = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    strings = texts.take(pa.array(held)).to_pylist()
    lists = [a.encode(strings), b.encode(strings)]
    whole = pa.array([b" " + t.encode() for t in strings], pa.binary())
    same = pc.and_(*(pc.equal(_Tokens(x, t).joined(), whole) for x, t in zip(lists, (a, b), strict=True)))
    good = np.flatnonzero(same.to_numpy(zero_copy_only=False))
    held, (ta, tb) = held[good], (_Tokens([x[i] for i in good], t) for x, t in zip(lists, (a, b), strict=True))
    counts = np.zeros((4, n), np.int64)
    texts_out = np.full(n, "", object)
    offsets, pairs, times = np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    if len(held):
        (a_doc_ends, a_ends), (b_doc_ends, b_ends) = ta.ends(), tb.ends()
        cuts = _shared_ends(ta, tb, a_doc_ends, b_doc_ends)
        starts = np.r_[np.int64(0), a_ends][ta.offsets[:-1]]
        cut_docs = cuts["doc"].to_numpy()
        cut_ends = cuts["end"].to_numpy() + starts[cut_docs]
        groups = _group_texts(ta, tb, np.searchsorted(cut_ends, a_ends), np.searchsorted(cut_ends, b_ends), written)
        shown = (g[:-1] for g in groups.to_pylist())
        texts_out[held] = list(shown) if keep_groups else [hashlib.sha256(g.encode()).hexdigest() for g in shown]
        x, y = _links(a_ends, b_ends)
        docs = ta.parents.to_numpy()[x]
        found = pa.table({"doc": docs, "pair": ta.ids.to_numpy()[x].astype(np.int64) << 32 | tb.ids.to_numpy()[y]})
        found = found.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by(
            [("doc", "ascending"), ("pair", "ascending")])
        counts[:, held] = [np.diff(ta.offsets), np.diff(tb.offsets), np.bincount(cut_docs, minlength=len(held)),
                           np.bincount(docs, minlength=len(held))]
        distinct = np.zeros(n, np.int64)
        distinct[held] = np.bincount(found["doc"].to_numpy(), minlength=len(held))
        np.cumsum(distinct, out=offsets[1:])
        pairs, times = found["pair"].to_numpy(), found["count_all"].to_numpy().astype(np.int32)
    at = pa.array(offsets, pa.int32())
    return [*map(pa.array, counts), pa.array(texts_out, pa.string()),
            pa.ListArray.from_arrays(at, pa.array(pairs)), pa.ListArray.from_arrays(at, pa.array(times))]


def _blocks(batch: pa.RecordBatch, text_at: int, letters: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text (a longer text stands alone)."""
    low, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()):
        if held and held + size > letters:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < batch.num_rows:
        yield batch.slice(low)


def align(docs: DataFrame, spec: bytes, pattern: str, model: bytes, id_col: str = "doc_id", text_col: str = "text",
          keep_groups: bool = False, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(id, block, n_a, n_b, n_groups, n_links, groups, pair, times) for every row of ``docs``;
    ``groups`` is the text of the groups if ``keep_groups``, else its sha-256."""
    spark = docs.sparkSession
    bound_batches(spark)
    files = spark.sparkContext.broadcast((spec, model))  # sizes fixed by the vocabularies
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(nonempty(batches))
        first = next(batches, None)
        if first is None:
            return
        a, b = byte_level_tokenizer(files.value[0], pattern), piece_tokenizer(files.value[1])
        written = pa.array([f"{i}{mark}" for i in range(max(len(a.pieces), len(b.pieces))) for mark in ",|;"])
        block = TaskContext.get().partitionId() << 32
        for batch in chain([first], batches):
            for part in _blocks(batch, 1, block_letters):
                columns = align_block(part.column(1), a, b, written, keep_groups)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(part), block)), *columns], names=[
                    "id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "pair", "times"])
                block += 1

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, block long, n_a long, n_b long, n_groups long, n_links long, "
                                "groups string, pair array<long>, times array<int>").withColumnRenamed("id", id_col)


def block_pairs(aligned: DataFrame) -> DataFrame:
    """(block, pair, docs): partial document counts.  A block that two batches share comes twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            lists = batch.column(1)
            flat = pa.table({"block": batch.column(0).take(pc.list_parent_indices(lists)), "pair": pc.list_flatten(lists)})
            found = flat.group_by(["block", "pair"], use_threads=False).aggregate([([], "count_all")])
            yield from found.rename_columns(["block", "pair", "docs"]).to_batches()

    return aligned.select("block", "pair").mapInArrow(run, "block long, pair long, docs long")


def pair_counts(partial: DataFrame) -> DataFrame:
    """(pair, n, top): in how many documents a pair is linked, and whether that is the most of
    all pairs of its A id.  The window holds at most one row for each id of the B vocabulary."""
    counts = partial.groupBy("pair").agg(F.sum("docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n", (F.col("n") == most).alias("top"))


def _measured(columns: list[str]):
    """Sums over a block's documents, given the counts of the block's pairs."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        pairs, first = np.unique(counts["pair"].to_numpy(), return_index=True)
        lists = docs["pair"].combine_chunks()
        at = first[np.searchsorted(pairs, pc.list_flatten(lists).to_numpy())]
        times = pc.list_flatten(docs["times"].combine_chunks()).to_numpy().astype(np.int64)
        offsets = np.r_[np.int64(0), np.cumsum(pc.list_value_length(lists).to_numpy())]

        def sums(values: np.ndarray) -> np.ndarray:
            return np.diff(np.r_[np.int64(0), np.cumsum(values * times)][offsets])

        best = sums(counts["top"].to_numpy()[at].astype(np.int64)) if len(at) else np.zeros(len(lists), np.int64)
        total = sums(counts["n"].to_numpy()[at]) if len(at) else np.zeros(len(lists), np.int64)
        return docs.select(columns).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    return run


def measure(docs: DataFrame, spec: bytes, pattern: str, model: bytes, id_col: str = "doc_id", text_col: str = "text",
            keep_groups: bool = False, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for every row of ``docs``."""
    aligned = scratch(align(docs, spec, pattern, model, id_col, text_col, keep_groups, block_letters), "aligned")
    partial = scratch(block_pairs(aligned), "block-pairs")
    known = partial.join(pair_counts(partial), "pair").select("block", "pair", "n", "top")
    columns = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups"]
    kind = aligned.schema[id_col].dataType.simpleString()
    return aligned.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _measured(columns), f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, "
                            "n_best long, count_sum long")


def default_tokenizers() -> tuple[bytes, str, bytes]:
    import public_tokenizers

    def content(name: str) -> bytes:
        with open(public_tokenizers.path(name), "rb") as f:
            return f.read()

    return content("byte_bpe_50k.json"), public_tokenizers.PATTERN, content("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"), *default_tokenizers()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
ORACLE: dict[str, str] = {}
