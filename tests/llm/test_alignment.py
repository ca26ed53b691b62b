import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalspark.llm import alignment, common
from tests.llm.conftest import DOCUMENTS

PARTS = alignment.default_tokenizers()


def brute(texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, token by token, with
    the tokenizers' own libraries over whole texts."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = {c: b for b, c in enumerate(alignment.byte_characters())}

    def piece(i: int) -> bytes:
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    rows, held = [], defaultdict(int)
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        a_bytes = [bytes(value[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + t.encode():
            rows.append(None)
            continue
        spans = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i, p in zip(ids, parts, strict=True):
                out.append((at, at + len(p), i))
                at += len(p)
            spans.append(out)
        links, low = [], 0
        for x in spans[0]:
            while spans[1][low][1] <= x[0]:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < x[1]:
                links.append((x[2], spans[1][k][2]))
                k += 1
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            sides = [",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans]
            groups.append("|".join(sides))
            low = cut
        for pair in set(links):
            held[pair] += 1
        rows.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(held[x] == most[x[0]] for x in r[3])
        out.append((*r[:3], len(r[3]), best, sum(held[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest()))
    return out


TEXTS = [None, "", "a", " ", "  ", "hello world", "Hello  World \n\n next\tline ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ marked",
         "x▁y", "日本語 テキスト 👍🏽 é́", "\x00\x07 control", "antidisestablishmentarianism 1234567 3.14", "hello world", "z" * 300,
         "ﬁ ligature ² Å   nbsp", " leading", "trailing  ", "\n", "don't you'll WE'VE", "word " * 200]


@pytest.mark.parametrize("letters", [1, 60, 10**6])
def test_equals_brute_force(spark, letters):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en", None, None), (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("block", F.lit(1)).withColumn("pair", F.lit("x")).repartition(3)
    got = alignment.measure(docs, *PARTS, block_letters=letters).collect()
    want = brute([r[1] for r in rows])
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    key = [(-1 if r[0] is None else r[0], *w) for r, w in zip(rows, want, strict=True)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[n] for n in names)) for r in got) == sorted(key)


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "hello world again")], "doc_id long, text string")
    row = alignment.align(docs, *PARTS, keep_groups=True).first()
    sides = [g.split("|") for g in row["groups"].split(";")]
    assert len(sides) == row["n_groups"] and sum(len(a.split(",")) for a, _ in sides) == row["n_a"]
    assert sum(row["times"]) == row["n_links"] and len(row["pair"]) == len(set(row["pair"]))


def test_query_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in docs], brute([t for _, t in docs]), strict=True))
    got = alignment.op11_tokenizer_alignment(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == want[r["doc_id"]]


def test_awkward_and_empty(spark, awkward, nothing):
    assert alignment.measure(awkward, *PARTS).count() == awkward.count()
    assert alignment.measure(nothing, *PARTS).collect() == []
    only_null = awkward.where("text IS NULL")
    assert [r["n_a"] for r in alignment.measure(only_null, *PARTS).collect()] == [0]


def test_unfit_descriptions_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        alignment.byte_level_tokenizer(b'{"pre_tokenizer": {"type": "Whitespace"}}', PARTS[1])
    assert common.BATCH_ROWS == 1000
