"""Operator 12: groups of spelling variants by PartEnum signatures.

A word is a binary vector: its dimensions are (letter, how often the letter stood before), its
ones the letters that it holds.  Words that differ by one replaced letter are at Hamming
distance two or less, words that differ by one inserted letter at distance one.  The dimensions
are dealt into parts; vectors at distance k differ in k parts at most, so they agree on all the
others: every way to leave out k parts gives a signature of the rest, and two such words share
at least one of them exactly.  Signatures also hold the length that two partners have in common
(the shorter one's) and one half of the spelling, since one edit leaves the first or the last
half of a word as it is.  Equal signatures meet in an equi-join; the edit distance of each
meeting pair is then verified.  Signatures are hashes; a collision only adds a pair that fails.

A word's form is its near word that occurs most often, if that one occurs at least twice as
often; roots follow forms to the last one, by doubling steps (counts at least double along a
chain, so it has 63 links at most).

Defined results: NULL and empty texts have no words; a NULL doc_id writes as nothing before the
colon; every row is counted, repeated ones too; other columns play no part.  Words of any length
are kept whole."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import bound_batches, nonempty, scratch, table, to_bytes

#: Parts of the dimensions for words of one length (distance two: every pair of parts is left
#: out once) and for lengths that differ by one (distance one: every part is left out once).
PARTS_SAME, PARTS_LONGER = 4, 2
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: A signature shared by more words is joined in tiles of so many.
TILE_ROWS = 2000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Letters from frequent to rare, so that neighbours in this order fall into different parts.
_ORDER = {c: i for i, c in enumerate("etaoinshrdlucmfwgpybvkjxqz")}


def count_words(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 97, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, one letter taken out of those whose
    hash with the document's id is divisible by ``every``; kept if long and frequent enough."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    # maximal runs only: a run is taken from its first letter on, or not at all
    find = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in nonempty(batches):
            for key, text in zip(to_bytes(batch.column(0)), to_bytes(batch.column(1)), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(key + b":")
                words = Counter(find(text.translate(_LOWER).decode()))
                for word in list(words):
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        n, at = words.pop(word), h % len(word)
                        if len(word) > least_letters:
                            held[word[:at] + word[at + 1:]] += n
                held.update(words)
                if len(held) > HELD_WORDS:
                    yield _word_batch(held)
                    held.clear()
        yield _word_batch(held)

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _word_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                      names=["word", "n"])


def _parts(word: str, parts: int) -> list[str]:
    """The word's letters as sorted texts, one for each part of the dimensions; a letter that
    comes again is another dimension, in the next part."""
    seen: Counter[str] = Counter()
    out: list[list[str]] = [[] for _ in range(parts)]
    for c in word:
        out[(_ORDER.get(c, ord(c)) + seen[c]) % parts].append(c)
        seen[c] += 1
    return ["".join(sorted(x)) for x in out]


def signatures(word: str) -> list[tuple[int, int]]:
    """(signature, role) of a word; role 0 meets 0 (one length), role 1 (shorter) meets 2.  The
    last bit of a signature says which of the two it is."""
    n, out = len(word), []

    def add(parts: list[str], out_of: int, length: int, halves: tuple[str, str], role: int) -> None:
        for keep in combinations(range(len(parts)), len(parts) - out_of):
            rest = "\0".join(parts[i] for i in keep)
            for side, half in zip("<>", halves, strict=True):
                key = f"{keep}{length}{side}{rest}\0{half}"
                out.append((xxhash.xxh3_64_intdigest(key.encode()) & ~1 | (role > 0), role))

    add(_parts(word, PARTS_SAME), 2, n, (word[: n // 2], word[n // 2:]), 0)
    two = _parts(word, PARTS_LONGER)
    add(two, 1, n, (word[: n // 2], word[n // 2:]), 1)
    less = n - 1  # the length of a partner that is one shorter
    add(two, 1, less, (word[: less // 2], word[less // 2 + 1:]), 2)
    return out


def signed(words: DataFrame) -> DataFrame:
    """(sig, role, word, n) for every signature of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            found = [signatures(w) for w in batch.column(0).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            sig, role = np.array([s for x in found for s in x], np.uint64).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig.astype(np.int64)), pa.array(role.astype(np.int8)), *batch.take(pa.array(at)).columns],
                names=["sig", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "sig long, role byte, word string, n long")


def near_pairs(words: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, near, n, near_n): every two words that differ by exactly one edit, once in each
    direction.  The rows of a signature that very many words share are cut into tiles on one
    side and repeated for each tile on the other, so no task meets them all."""
    rows = scratch(signed(words), "signatures")
    many = rows.groupBy("sig").count().where(F.col("count") > tile_rows)
    # written first, so that its size is known and it is only broadcast if small
    many = scratch(many.select("sig", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")), "shared")
    rows = rows.join(many, "sig", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    left = rows.where("role <> 2").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    right = rows.where("role <> 1").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.select("sig", "tile", "role", "word", "n")
    right = right.select("sig", "tile", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = left.join(right, ["sig", "tile"]).where((F.col("role") == 1) | (F.col("word") < F.col("near")))
    pairs = met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "n", "near_n").distinct()
    pairs = scratch(pairs, "near-words")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"),
                                          F.col("near_n").alias("n"), F.col("n").alias("near_n")))


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): of the near words the most frequent one (of equal ones the
    first in code-point order), if it occurs at least twice as often."""
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.down") >= 2 * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                         F.when(enough, F.col("best.near")).alias("form"),
                         F.when(enough, -F.col("best.down")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form; each round doubles the steps followed."""
    step = scratch(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = scratch(step.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"),
                                                             F.col("on").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the documents."""
    words = scratch(count_words(docs, id_col=id_col, text_col=text_col), "words")
    found = scratch(forms(words, near_pairs(words, tile_rows)), "forms")
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE: dict[str, str] = {}
