"""Dataset preparation (P1-P12): splits, samples, label maps, prompts, training examples,
leakage checks and chat formatting.  Everything is narrow (per-row expressions) except P3's
top-N, P10's count, P11's join and P12's per-conversation assembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from evalspark.functions.hashing import h32, hash_bucket
from evalspark.functions.text import join_tokens, render_prompt


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- P1 / P2: seeded hash splits --------------------------------------------------------

def split3(df: DataFrame, key: str, seed: int = 42, test_size: float = 0.2, buckets: int = 10000,
           names=("train", "validation", "test"), col: str = "split") -> DataFrame:
    """Seeded 3-way split: ``test_size`` held out, then halved into validation and test.
    A keyed hash bucket, so the assignment is disjoint, exhaustive and independent of
    partitioning (unlike ``randomSplit``)."""
    b = hash_bucket(key, seed, buckets)
    cut_train = int(round(buckets * (1 - test_size)))
    cut_val = cut_train + (buckets - cut_train) // 2
    return df.withColumn(col, F.when(b < cut_train, names[0]).when(b < cut_val, names[1]).otherwise(names[2]))


def split2(df: DataFrame, key: str, seed: int = 42, holdout: float = 0.1, buckets: int = 10000,
           source_col: str = "split", source_value: str = "train", names=("train", "validation"),
           col: str = "split") -> DataFrame:
    """Carve ``holdout`` of the rows whose source split is ``source_value``; others keep
    their split."""
    b = hash_bucket(key, f"{seed}:2", buckets)
    cut = int(round(buckets * (1 - holdout)))
    new = F.when(b < cut, names[0]).otherwise(names[1])
    return df.withColumn(col, F.when(F.col(source_col) == source_value, new).otherwise(F.col(source_col)))


# --- P3: first-N sample -------------------------------------------------------------------

def first_n(df: DataFrame, n: int, order_by: str, sample: str = "prefix", seed: int = 42) -> DataFrame:
    """The first ``n`` rows by ``order_by`` (TakeOrderedAndProject: per-partition top-n,
    then a merge of n x partitions rows).  ``sample='hash'`` orders by a seeded hash first,
    avoiding the class skew of a prefix."""
    if sample == "hash":
        return df.withColumn("_h", hash_bucket(order_by, seed, 1 << 30)).orderBy("_h", order_by).limit(n).drop("_h")
    return df.orderBy(order_by).limit(n)


# --- P4 / P5 / P10: label maps -------------------------------------------------------------

def label_to_id(df: DataFrame, label_col: str, table: dict, out: str = "label",
                normalize: bool = True) -> DataFrame:
    """P5: label word -> id; unknown labels are dropped (inner semantics of a lookup)."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    lab = F.lower(F.trim(_c(label_col))) if normalize else _c(label_col)
    return df.withColumn(out, F.try_element_at(m, lab)).filter(F.col(out).isNotNull())


def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """P10: rows per label (partial aggregation; the result is one row per class)."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


# --- P6-P8: text + prompts ---------------------------------------------------------------

def format_samples(df: DataFrame, template: str, text, completion: Column, max_chars: int = 400) -> DataFrame:
    """Prompt from the template (one literal ``{text}`` replacement of the first
    ``max_chars`` characters) + completion."""
    return df.withColumn("prompt", render_prompt(template, text, max_chars)) \
        .withColumn("completion", completion)


def tokens_to_text(df: DataFrame, tokens: str = "tokens", out: str = "text") -> DataFrame:
    """P6."""
    return df.withColumn(out, join_tokens(tokens))


# --- P9: training examples ----------------------------------------------------------------

def hashed_whitespace_ids(text, vocab: int = 50000) -> Column:
    """Default tokenizer: whitespace terms -> ``h32(term) % vocab`` (JVM-side, no Python)."""
    terms = F.filter(F.split(_c(text), r"\s+"), lambda t: t != "")
    return F.transform(terms, lambda t: (h32(t) % vocab).cast("int"))


def training_examples(df: DataFrame, prompt: str = "prompt", completion: str = "completion",
                      max_length: int | None = None, tokenize=None, eos_id: int | None = None) -> DataFrame:
    """ids = tokens(prompt) ++ tokens(completion) (+ eos), cut to ``max_length`` if given;
    labels = ids with prompt positions masked to -100; attention mask of ones.

    ``tokenize`` maps a Column of text to a Column of ``array<int>`` (default: hashed
    whitespace terms); a subword tokenizer can be plugged in as an Arrow ``pandas_udf``."""
    tok = tokenize or hashed_whitespace_ids
    p_ids, c_ids = tok(_c(prompt)), tok(_c(completion))
    if eos_id is not None:
        c_ids = F.concat(c_ids, F.array(F.lit(int(eos_id))))
    full = F.concat(p_ids, c_ids)
    if max_length is not None:
        full = F.slice(full, 1, max_length)
    out = df.withColumn("_plen", F.size(p_ids)).withColumn("input_ids", full)
    out = out.withColumn("labels", F.transform("input_ids", lambda x, i: F.when(i < F.col("_plen"), F.lit(-100)).otherwise(x)))
    out = out.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    return out.drop("_plen")


def tokenizer_udf(fn):
    """Wrap ``fn(list[str]) -> list[list[int]]`` as an Arrow ``pandas_udf`` usable as
    ``training_examples(tokenize=...)``.  Runs once per Arrow batch, not per row."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def _tok(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.fillna("").tolist()))

    return _tok


# --- P11: leakage / contamination -----------------------------------------------------------

WORD_PATTERN = r"[^\p{L}\p{N}]+"


def words(text, pattern: str = WORD_PATTERN) -> Column:
    """Lower-case words: runs of letters/digits (any script)."""
    return F.filter(F.split(F.lower(_c(text)), pattern), lambda t: t != "")


def ngram_windows(ws, n: int) -> Column:
    """Array of ``struct(w0..w{n-1})``: every run of n consecutive words, built from n shifted
    slices zipped together (no lambda: lambdas are interpreted, zips and slices are not)."""
    t = _c(ws)
    m = F.greatest(F.size(t) - n + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(t, k + 1, m).alias(f"w{k}") for k in range(n)])


def _gram_keys(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, k1, k2) per n-gram occurrence: two independent hashes (xxhash64, murmur3) of n word
    hashes, computed in a code-generated projection after the explode.  Each word is hashed
    once; windows are structs of n longs, and only 12 bytes per gram cross the exchange."""
    # word hashes are projected once; the window builder references them n times, so Catalyst
    # keeps this projection instead of inlining the tokeniser into every slice
    w = df.select(id_col, F.transform(words(text_col), lambda x: F.xxhash64(x)).alias("_w"))
    g = w.select(id_col, F.explode(ngram_windows(F.col("_w"), n)).alias("g"))
    cols = [F.col(f"g.w{k}") for k in range(n)]
    return g.select(id_col, F.xxhash64(*cols).alias("k1"), F.hash(*cols).alias("k2"))


def key_filter(keys: DataFrame, bits: int) -> Column:
    """A bitmap of ``2 ** bits`` bits with two bits per key (k1, k2), as a scalar array of longs.
    Tasks merge it word by word (a partial ``bit_or``), so its size never depends on the keys."""
    places = keys.select(F.explode(F.array(*[_place(k, bits) for k in ("k1", "k2")])).alias("p"))
    held = places.groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) AS int))")).alias("set"))
    every = keys.sparkSession.range(2 ** bits // 64).select(F.col("id").cast("int").alias("word"))
    dense = every.join(held, "word", "left").select("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("f")).scalar()


def _place(key: str, bits: int) -> Column:
    return F.col(key).cast("long").bitwiseAND(F.lit(2 ** bits - 1))


def may_hold(found: Column, bits: int) -> Column:
    """Whether both bits of (k1, k2) are set in a ``key_filter``."""
    def bit(key: str) -> Column:
        place = _place(key, bits)
        return F.getbit(F.get(found, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1

    return bit("k1") & bit("k2")


def ngram_overlap(docs: DataFrame, bench: DataFrame, n: int = 8, doc_id: str = "doc_id",
                  item_id: str = "item_id", text: str = "text", filter_bits: int = 24) -> DataFrame:
    """P11 (passage overlap): documents sharing at least one word n-gram with a benchmark item,
    with the number of distinct items and distinct shared n-grams.

    A bitmap of the benchmark's keys (``2 ** filter_bits`` bits, 2 MB) drops almost all n-grams of
    the documents inside the scan stage; only candidates reach the join, whether AQE broadcasts
    the benchmark's keys or shuffles both sides.  Text never reaches an exchange.  The bitmap
    only saves work: raise its size with the benchmark (16 bits a key leave one in 60)."""
    bk = _gram_keys(bench, item_id, text, n).distinct()
    dk = _gram_keys(docs.select(doc_id, text), doc_id, text, n)
    dk = dk.where(may_hold(key_filter(bk.select("k1", "k2"), filter_bits), filter_bits))
    j = dk.join(bk, ["k1", "k2"])
    return j.groupBy(doc_id).agg(F.count_distinct(item_id).alias("n_items"),
                                 F.count_distinct("k1", "k2").alias("n_shared_ngrams"))


def normalized_text_key(text) -> Column:
    """Exact-duplicate key: sha-256 of lower-cased, whitespace-collapsed, trimmed text."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(_c(text)), r"\s+", " ")), 256)


def exact_overlap(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                  text: str = "text") -> DataFrame:
    """P11 (exact copies): documents whose normalised text equals that of a benchmark item, with
    the number of such items.  Items are counted per 256-bit key first, so a text with d document
    copies and b item copies gives d rows, and AQE can split a key's documents over tasks."""
    d = docs.select(doc_id, normalized_text_key(text).alias("key"))
    b = bench.groupBy(normalized_text_key(text).alias("key")).agg(F.count(item_id).alias("n_items"))
    return d.join(b, "key").select(doc_id, "n_items")


# --- P12: chat formatting -------------------------------------------------------------------

def render_turn(role, text, start: str = "<|", mid: str = "|>", end: str = "<|end|>") -> Column:
    """One turn in the ``<|role|>content<|end|>`` chat format."""
    return F.concat(F.lit(start), _c(role), F.lit(mid), _c(text), F.lit(end))


def chat_format(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", add_generation_prompt: bool = False,
                generation_prompt: str = "<|assistant|>") -> DataFrame:
    """Conversation -> one chat-formatted string.  Each turn is rendered narrowly, then
    the pieces of a conversation are ordered by turn and concatenated; the output is one value
    per conversation, so the group's size is the output's size."""
    pieces = conv.select(conv_id, F.struct(F.col(turn).alias("t"), render_turn(role, text).alias("s")).alias("p"))
    g = pieces.groupBy(conv_id).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    chat = F.array_join(F.transform("ps", lambda x: x["s"]), "")
    if add_generation_prompt:
        chat = F.concat(chat, F.lit(generation_prompt))
    return g.select(conv_id, chat.alias("chat"), F.size("ps").alias("n_turns"))


def chat_segments(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", block: int = 1024) -> DataFrame:
    """P12 without collecting a conversation: each turn rendered (narrow) with its character
    offset in the assembled chat string; concatenating segments in offset order gives
    ``chat_format``'s string.  Offsets are a two-level prefix sum: per (conversation, block of
    ``block`` turns) totals by partial aggregation, a running sum over a conversation's blocks,
    and a running sum inside each block (at most ``block`` rows).  A conversation holding a
    third of all turns is thereby split into many small window partitions."""
    seg = conv.select(conv_id, turn, render_turn(role, text).alias("segment"))
    seg = seg.withColumn("_len", F.length("segment").cast("bigint")) \
        .withColumn("_blk", F.floor(F.col(turn) / F.lit(block)))
    blk = seg.groupBy(conv_id, "_blk").agg(F.sum("_len").alias("_bl"))
    before = Window.unboundedPreceding
    wb = Window.partitionBy(conv_id).orderBy("_blk").rowsBetween(before, -1)
    blk = blk.select(conv_id, "_blk", F.coalesce(F.sum("_bl").over(wb), F.lit(0).cast("bigint")).alias("_boff"))
    wi = Window.partitionBy(conv_id, "_blk").orderBy(turn).rowsBetween(before, -1)
    seg = seg.withColumn("_ioff", F.coalesce(F.sum("_len").over(wi), F.lit(0).cast("bigint")))
    out = seg.join(blk, [conv_id, "_blk"])
    return out.select(conv_id, turn, (F.col("_boff") + F.col("_ioff")).alias("offset"), "segment")
