"""Operator 2: byte-level BPE encoding and decoding.

A sentencepiece BPE model is serialised straight from a byte vocabulary: every vocabulary
entry becomes a piece whose bytes are written as printable characters (a fixed one-to-one
map), scored by its negative rank, with an identity normaliser.  Merging the best-scored
adjacent pair is then the same as merging the pair of lowest rank.  Texts are cut into
pre-tokens first, and each pre-token is encoded by itself; decoding maps ids back to bytes.

Defined results: a NULL or empty text has no tokens and decodes to no bytes; texts of any
length are encoded whole; equal rows give equal results; other columns play no part."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import bound_batches, list_array, nonempty, released, table

#: Pre-tokens whose ids one Python worker remembers; a full memory is emptied (speed only).
CACHE_ENTRIES = 200_000


def byte_characters() -> list[str]:
    """One printable character for each byte: printable Latin-1 bytes stand for themselves,
    the others take the characters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: integers as varints, floats as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(entry) for entry, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """The sentencepiece ModelProto of a byte vocabulary.  A piece's id is its rank; the
    unknown piece, which no text reaches, stands last."""
    show = byte_characters()
    model = bytearray()
    for rank, entry in enumerate(vocabulary):
        piece = "".join(show[b] for b in entry).encode()
        model += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))  # 1: normal
    unknown = len(vocabulary)
    model += _field(1, _field(1, b"<unk>") + _field(2, -float(unknown)) + _field(3, 2))  # 2: unknown
    none = (1 << 64) - 1  # -1: the model has no such piece
    model += _field(2, _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown)  # 3, 2: BPE
                    + _field(41, none) + _field(42, none) + _field(43, none))
    model += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(model)


def _encoder(model: bytes, pattern: str):
    """A function from a list of texts to their flat ids and row offsets."""
    import regex
    import sentencepiece

    split = regex.compile(pattern).findall
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    to_shown = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}
    space = byte_characters()[0x20]
    known: dict[str, bytes] = {}  # ids as 32-bit integers, so that a row's ids are joined as bytes

    def show(piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", space)
        return piece.encode().decode("latin-1").translate(to_shown)

    def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [split(t) if t else [] for t in texts]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list(set().union(*pieces).difference(known))
        ids = processor.encode(list(map(show, new)), num_threads=1)
        known.update(zip(new, (array("i", x).tobytes() for x in ids), strict=True))
        rows = [b"".join(map(known.__getitem__, p)) for p in pieces]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        return np.frombuffer(b"".join(rows), np.int32), offsets

    return encode


def encode(docs: DataFrame, vocabulary: list[bytes], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(vocabulary))  # size fixed by the vocabulary
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(nonempty(batches))
        first = next(batches, None)
        if first is None:
            return
        of = _encoder(model.value, pattern)
        for batch in chain([first], batches):
            for part in _slices(batch):
                ids, offsets = of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_array(ids, offsets, pa.int32())], names=["id", "token_ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: list[bytes], pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded): ``encode`` and ``decode`` in one pass, so that a task keeps one
    Python worker and ids are not handed over and back in between."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((serialise_model(vocabulary), vocabulary))  # size fixed by the vocabulary
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(nonempty(batches))
        first = next(batches, None)
        if first is None:
            return
        model, entries = sent.value
        of = _encoder(model, pattern)
        for batch in chain([first], batches):
            for part in _slices(batch):
                ids, offsets = of(part.column(1).to_pylist())
                flat = list(map(entries.__getitem__, ids.tolist()))
                decoded = [b"".join(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, offsets, pa.int32()), pa.array(decoded, pa.binary())],
                                                 names=["id", "token_ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"id {kind}, token_ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch, letters: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so much text each (a longer text stands alone)."""
    low, held = 0, 0
    for i, size in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
        held += size or 0
        if held >= letters or i == batch.num_rows - 1:
            yield batch.slice(low, i + 1 - low)
            low, held = i + 1, 0


def decode(encoded: DataFrame, vocabulary: list[bytes], ids_col: str = "token_ids",
           out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for (NULL ids: NULL)."""
    spark = encoded.sparkSession
    entries = spark.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = entries.value.__getitem__
        for batch in batches:
            out = [None if ids is None else b"".join(map(get, ids)) for ids in map(_as_list, batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def _as_list(row: pa.ListScalar) -> list[int] | None:
    return row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else None


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from real ids and decoded bytes."""
    return encoded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def default_vocabulary() -> tuple[list[bytes], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def encode_and_decode(docs: DataFrame) -> DataFrame:
    vocabulary, pattern = default_vocabulary()
    return digests(round_trip(docs, vocabulary, pattern))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLE: dict[str, str] = {}
