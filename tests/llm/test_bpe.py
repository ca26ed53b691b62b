import base64

import pytest

from evalspark.llm import bpe
from tests.llm.conftest import sha, texts_of


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(result, rows, reference):
    want = sorted((-1 if i is None else i, len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
                  for i, t in rows for ids in [reference.encode_ordinary(t or "")])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in result.collect())
    assert got == want


def test_query_equals_tiktoken(spark, sf, reference):
    check(bpe.op2_byte_bpe(spark, sf), texts_of(spark.read.parquet(f"{sf}/documents.parquet")), reference)


def test_awkward_rows(awkward, reference):
    check(bpe.encode_and_decode(awkward), texts_of(awkward), reference)


def test_empty_table(nothing):
    assert bpe.encode_and_decode(nothing).collect() == []


def test_clashing_columns_are_ignored(spark):
    rows = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, token_ids int, decoded string")
    vocabulary, pattern = bpe.default_vocabulary()
    got = bpe.decode(bpe.encode(rows, vocabulary, pattern), vocabulary).first()
    assert bytes(got["decoded"]) == b"a b" and len(got["token_ids"]) == 2


def test_small_vocabulary_merges_lowest_rank_first(spark):
    vocabulary = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc"]
    rows = spark.createDataFrame([(1, "abc"), (2, "abab"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["token_ids"] for r in bpe.encode(rows, vocabulary, r"\S+|\s+").collect()}
    # "bc" merges first, and then "a" with "bc"
    assert got == {1: [258], 2: [257, 257], 3: []}


def test_one_pass_equals_encode_and_decode(spark, awkward, nothing):
    vocabulary, pattern = bpe.default_vocabulary()
    for docs in (awkward, nothing):
        one = bpe.round_trip(docs, vocabulary, pattern)
        two = bpe.decode(bpe.encode(docs, vocabulary, pattern), vocabulary)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
