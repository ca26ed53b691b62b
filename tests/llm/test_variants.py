import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import variants
from tests.llm.conftest import DOCUMENTS, ascii_lower


def brute_words(rows) -> dict:
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows) -> dict:
    """{word: (form, root, n, n_near, form_n)}."""
    words = brute_words(rows)
    near = {w: [] for w in words}
    # words one edit apart share a text with one letter left out, or one of them is such a text
    holders = {}
    for w in words:
        for i in range(len(w)):
            holders.setdefault(w[:i] + w[i + 1:], set()).add(w)
    for cut, of in holders.items():
        for a, b in combinations(sorted(of | ({cut} & words.keys())), 2):
            if one_edit(a, b) and b not in near[a]:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(frame) -> dict:
    rows = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@given(st.text("abcdé", min_size=5, max_size=9), st.data())
@settings(max_examples=300, deadline=None)
def test_words_one_edit_apart_share_a_signature(word, data):
    kind, at = data.draw(st.sampled_from("rid")), data.draw(st.integers(0, len(word) - 1))
    c = data.draw(st.sampled_from("abcdéz"))
    other = {"r": word[:at] + c + word[at + 1:], "i": word[:at] + c + word[at:], "d": word[:at] + word[at + 1:]}[kind]
    if other == word:
        return
    a, b = ({(s, r) for s, r in variants.signatures(w)} for w in (word, other))
    meets = any(s == t and {r, q} in ({0}, {1, 2}) for s, r in a for t, q in b)
    assert meets


@pytest.mark.parametrize("tile_rows", [2, 2000])
def test_equals_brute_force_on_crafted_words(spark, tile_rows):
    stems = ["colour", "color", "colours", "couleur", "straße", "strasse", "abcde", "abcdf", "bcdea", "aaaaaaaaaa", "aaaaaaaaaaa"]
    rows = []
    for i, w in enumerate(stems):
        rows += [(i * 10 + k, f"{w} {w.upper()}, {w}-{w}") for k in range(2 ** (i % 5))]
    rows += [(900 + i, " ".join(f"prefix{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abcd")) for i in range(4)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS).repartition(4)
    assert found(variants.variants(docs, tile_rows=tile_rows)) == brute(rows)


def test_chains_are_followed_to_their_ends(spark):
    chain = ["aaaaabbbbb"[:5] + "c" * k for k in range(9)]
    rows = [(i, f"{w} " * 3 * 2 ** i) for i, w in enumerate(chain)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    got = found(variants.variants(docs))
    assert got == brute(rows) and len({r for _, r, *_ in got.values()}) < len(got)


def test_query_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(variants.op12_spelling_variants(spark, sf)) == brute(rows)


def test_awkward_and_empty(spark, awkward, nothing):
    texts = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    wide = awkward.withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    assert found(variants.variants(wide)) == brute(texts)
    assert variants.variants(nothing).collect() == []
