"""ROUGE (M3a-d).

* ROUGE-N (M3a) is native: rows are dealt by key once, n-grams are exploded and *counted per
  (pair, n-gram)* in one aggregation (both sides at once, no join); the clipped overlap is
  then summed per pair.  Both aggregations run inside the row's partition.
* ROUGE-L (M3b) needs a longest common subsequence: an ``arrow_udf`` over the two
  token arrays.  Its cost follows the match points of a pair, or n * m / 64 machine-word
  operations where that is less.
* Stemming (M3d) happens inside ROUGE: a Porter ``arrow_udf``, memoised per worker; ROUGE-L
  stems in the task that takes the subsequence, so its tokens cross to Python once.

A batch stays in Arrow and is worked on in runs of rows: only the distinct tokens of a run and the
tokens of one pair at a time become Python objects.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from evalspark.functions import porter
from evalspark.functions.text import word_tokens


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rouge_tokens(text) -> Column:
    """ROUGE tokeniser: lower case, non-[a-z0-9] runs -> blank, split, drop empties."""
    return word_tokens(text)


def _fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n(df: DataFrame, keys, reference: str = "reference", prediction: str = "prediction",
            n: int = 1, stem: bool = False) -> DataFrame:
    """ROUGE-N precision / recall / F per row of ``df`` (identified by ``keys``).

    Both texts stand in one row, so rows are dealt by key before the explode: the two
    aggregations need no further exchange, and no n-gram crosses one.  Each row is tokenised once, its two sides are exploded (a 2-element array), then
    each side's n-gram windows (``explode_outer`` keeps a row whose side has none); the gram
    hash is computed from the n words in generated code.  One aggregation per (row, gram)
    clips the counts, a second per row sums overlap and the per-side totals - no self-join."""
    from evalspark.operators.prepare import ngram_windows

    keys = list(keys)
    rt, pt = rouge_tokens(reference), rouge_tokens(prediction)
    if stem:
        rt, pt = stem_tokens_udf(rt), stem_tokens_udf(pt)
    base = df.select(*keys, rt.alias("_rt"), pt.alias("_pt")).repartition(*keys)
    sides = F.array(F.struct(F.lit(1).alias("r"), F.lit(0).alias("p"), ngram_windows(F.col("_rt"), n).alias("w")),
                    F.struct(F.lit(0).alias("r"), F.lit(1).alias("p"), ngram_windows(F.col("_pt"), n).alias("w")))
    x = base.select(*keys, F.explode(sides).alias("s"))
    g = x.select(*keys, "s.r", "s.p", F.explode_outer("s.w").alias("g"))
    present = F.col("g").isNotNull()
    h = F.when(present, F.xxhash64(*[F.col(f"g.w{k}") for k in range(n)]))
    g = g.select(*keys, h.alias("h"), F.when(present, F.col("r")).otherwise(0).alias("r"),
                 F.when(present, F.col("p")).otherwise(0).alias("p"))
    per_gram = g.groupBy(*keys, "h").agg(F.sum("r").alias("cr"), F.sum("p").alias("cp"))
    j = per_gram.groupBy(*keys).agg(F.sum(F.least("cr", "cp")).alias("overlap"),
                                    F.sum("cr").alias("n_ref"), F.sum("cp").alias("n_pred"))
    p = F.col("overlap") / F.greatest(F.col("n_pred"), F.lit(1))
    r = F.col("overlap") / F.greatest(F.col("n_ref"), F.lit(1))
    return j.select(*keys, p.alias("precision"), r.alias("recall"), _fmeasure(p, r).alias("f"))


# --- LCS -------------------------------------------------------------------------------------

#: A match point costs the sparse form about as much as so many cells cost the dense one.
CELLS_PER_MATCH = 2000


def lcs_length(a: list, b: list) -> int:
    """LCS length.  Common ends are cut off, and tokens that the other side lacks are left out.
    Then the cheaper of two exact forms runs: over match points (cost follows the equal pairs of
    tokens, so long texts of many words are cheap) or over bit rows (cost follows the cells)."""
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    ends = low + len(a) - high_a
    shared = set(a[low:high_a]).intersection(b[low:high_b])
    a, b = [t for t in a[low:high_a] if t in shared], [t for t in b[low:high_b] if t in shared]
    if not a or not b:
        return ends
    if len(a) < len(b):
        a, b = b, a
    many = Counter(a)
    matches = sum(many[t] * n for t, n in Counter(b).items())
    return ends + (_lcs_sparse if matches * CELLS_PER_MATCH <= len(a) * len(b) else _lcs_bits)(a, b)


def _lcs_sparse(a: list, b: list) -> int:
    """Match points in the order of ``b``: ``ends[k]`` is the smallest place in ``a`` where a common
    subsequence of k + 1 tokens can end (Hunt and Szymanski)."""
    places: dict = {}
    for i in range(len(a) - 1, -1, -1):  # descending, so a token of b extends no chain twice
        places.setdefault(a[i], []).append(i)
    ends: list[int] = []
    for token in b:
        for i in places[token]:
            k = bisect_left(ends, i)
            if k == len(ends):
                ends.append(i)
            else:
                ends[k] = i
    return len(ends)


def _lcs_bits(a: list, b: list) -> int:
    """One big-integer row per token of ``b`` (Allison-Dix / Hyyro).  The rows of a token's places
    in ``a`` are kept for as many tokens as fit into 32 MB."""
    places: dict = {}
    for i, tok in enumerate(a):
        places.setdefault(tok, []).append(i)
    kept: dict = {}
    room = max(1, (1 << 28) // len(a))
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        m = kept.get(tok)
        if m is None:
            row = bytearray((len(a) + 7) // 8)
            for i in places[tok]:
                row[i >> 3] |= 1 << (i & 7)
            m = int.from_bytes(row, "little")
            if len(kept) < room:
                kept[tok] = m
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _flat(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all rows in one array, and the place where each row begins (a null has none)."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0)
    return tokens.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype="int64")])


#: Tokens of a batch that are worked on at once (more where one row has more).
TOKENS_AT_ONCE = 1 << 18


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring rows of at most ``TOKENS_AT_ONCE`` tokens, or of one row."""
    low, end = 0, len(at) - 1
    while low < end:
        high = max(low + 1, int(np.searchsorted(at, at[low] + TOKENS_AT_ONCE, "right")) - 1)
        yield low, min(high, end)
        low = high


def _numbered(words: pa.Array, numbers: dict, stem: bool) -> np.ndarray:
    """Each token as the number of its text, or of its stem's; each distinct one is looked up once."""
    coded = words.dictionary_encode(null_encoding="encode")
    known = coded.dictionary.to_pylist()
    to = [numbers.setdefault(_stem_cached(t) if stem else t, len(numbers)) for t in known]
    return np.array(to, "int64")[coded.indices.to_numpy()]


def _lcs_lengths(a: pa.Array, b: pa.Array, stem: bool) -> pa.Array:
    """LCS length of each row.  Tokens are numbered run by run; one pair at a time is two lists."""
    (x, at_x), (y, at_y) = _flat(a), _flat(b)
    lengths = np.zeros(len(a), "int32")
    for low, high in _runs(at_x + at_y):
        numbers: dict = {}
        from_x, from_y = at_x[low], at_y[low]
        p = _numbered(x[from_x: at_x[high]], numbers, stem)
        q = _numbered(y[from_y: at_y[high]], numbers, stem)
        for i in range(low, high):
            lengths[i] = lcs_length(p[at_x[i] - from_x: at_x[i + 1] - from_x].tolist(),
                                    q[at_y[i] - from_y: at_y[i + 1] - from_y].tolist())
    return pa.array(lengths)


@F.arrow_udf(IntegerType())
def lcs_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _lcs_lengths(a, b, stem=False)


@F.arrow_udf(IntegerType())
def lcs_of_stems_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """``lcs_udf`` of ``stem_tokens_udf`` of both sides in one Python worker, without a way back to
    the JVM between them (Spark runs a function of two Python functions in two workers a task)."""
    return _lcs_lengths(a, b, stem=True)


def rouge_l(df: DataFrame, keys, reference: str = "reference", prediction: str = "prediction",
            stem: bool = False) -> DataFrame:
    """ROUGE-L precision / recall / F per row; empty side -> 0, 0, 0.  A token has one stem, so
    stems leave the sizes as they are."""
    rt, pt = rouge_tokens(reference), rouge_tokens(prediction)
    base = df.select(*keys, rt.alias("_rt"), pt.alias("_pt"))
    x = base.select(*keys, F.size("_rt").alias("n_ref"), F.size("_pt").alias("n_pred"),
                    (lcs_of_stems_udf if stem else lcs_udf)("_rt", "_pt").alias("lcs"))
    ok = (F.col("n_ref") > 0) & (F.col("n_pred") > 0)
    p = F.when(ok, F.col("lcs") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(ok, F.col("lcs") / F.col("n_ref")).otherwise(F.lit(0.0))
    return x.select(*keys, "lcs", p.alias("precision"), r.alias("recall"), _fmeasure(p, r).alias("f"))


# --- stemming ----------------------------------------------------------------------------------

@lru_cache(maxsize=1 << 16)
def _stem_cached(tok: str) -> str:
    return porter.stem(tok) if len(tok) > 3 else tok


def _stems(words: pa.Array) -> pa.Array:
    """The stem of every token; each distinct one is looked up once."""
    coded = words.dictionary_encode()
    return pa.array([_stem_cached(t) for t in coded.dictionary.to_pylist()], words.type).take(coded.indices)


@F.arrow_udf(ArrayType(StringType()))
def stem_tokens_udf(tokens: pa.Array) -> pa.Array:
    """Porter-stem every token of each array (memoised per worker, so the cost follows the
    vocabulary)."""
    words, at = _flat(tokens)
    stems = [_stems(words[k: k + TOKENS_AT_ONCE]) for k in range(0, len(words), TOKENS_AT_ONCE)]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.concat_arrays(stems or [words]), mask=tokens.is_null())


def mean_scores(scores: DataFrame, by, col: str = "f", out: str = "mean_f") -> DataFrame:
    """Mean score per group."""
    return scores.groupBy(*by).agg(F.avg(col).alias(out), F.count(F.lit(1)).alias("n"))
