"""Operator 6: substring dedup with prefix-partitioned suffix trees.

A window is ``window`` consecutive words.  A window occurrence is repeated if the same words
also start in a document with a smaller id; all words of repeated occurrences are removed.

1. *Sparse suffixes.*  Every window selects one word position inside it, the smallest hash of
   ``prefix`` consecutive words (leftmost of equals), so equal windows select equal places.
   Only suffixes at selected positions are kept, about one in ``(window - prefix) / 2``; each
   owns the run of windows that selected it and the *stretch* of words which they cover.
2. *Prefix partitions.*  Suffixes are grouped by their first ``prefix`` words.  Prefixes seen
   in one document only cannot repeat and go.  Equal stretches of a prefix are one class, by
   partial aggregation; all of a class's occurrences beyond its smallest document are repeats
   without further work, so copies never reach a tree.
3. *Longer prefixes.*  The trees of a group must fit in a task.  A group of more than ``group_rows``
   stretches is split by longer prefixes: its suffixes are told apart by how many words before the
   selected place they start, in two halves, and those of a half by all the words that they must
   have in common.  Each step halves again, for the groups that are still too large; at the end
   the prefix is the whole window, which is a deep node itself, whose smallest document is a
   partial aggregate.
4. *Subtrees.*  The suffixes of a group are sorted, with the length of the common prefix of each
   with its neighbour.  Runs of neighbours that share at least so many words are the internal
   nodes of the suffix tree; those of ``window`` words and more are its deep nodes.  For each
   suffix the deepest node that also holds a smaller document gives its longest repeat; repeats
   that continue one which starts a word before go, so what is left is maximal.

A repeat longer than a stretch comes in pieces, which meet when its document's spans are joined.

Defined results: NULL text has no words; documents shorter than a window lose nothing; rows
with NULL ids take no part in comparison and lose nothing; rows that repeat an id count as
that one document, and a repeat within a document is not removed; other columns play no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import U64, RunningHash, bound_batches, mix, record, released, scratch, table, to_bytes, word_hashes

PREFIX = 12
#: Stretches of one prefix that may meet in one tree (each some 80 words of 8 bytes).
GROUP_ROWS = 20_000
#: Words of the stretches for which one task builds trees at a time.
FOREST_WORDS = 1_000_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

_SUFFIX = pa.schema([("prefix", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()),
                     ("start", pa.int32()), ("n_windows", pa.int32()), ("more", pa.list_(pa.int32()))])
_GROUP = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
                    ("prefix", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()),
                    ("n_windows", pa.int32()), ("words", pa.binary())])
_SIZED = _GROUP.append(pa.field("n_rows", pa.int64()))
_REPEAT = pa.schema([("prefix", pa.int64()), ("stretch", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    split = [t.split() if t else [] for t in texts]
    return [word_hashes(w, len(w)) for w in split]


def sparse_suffixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """Step 1 for (id, text) rows: prefix and stretch hashes, document, first owned window and
    number of owned windows.  A stretch that a document repeats (a run of one word, say) is one
    row; ``more`` has its other places."""
    span = window - prefix + 1  # prefix starts in a window

    def suffixes(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(h) for h in hashes])
        flat = np.concatenate(hashes)
        prefixes, first, second = (RunningHash(flat, b) for b in _BASES)
        at = np.arange(len(flat) - prefix + 1)
        order = prefixes.of(at, at + prefix)
        selected = np.lib.stride_tricks.sliding_window_view(order, span).argmin(axis=1)
        selected = selected + np.arange(len(selected))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        own = np.flatnonzero(doc[: len(selected)] == doc[window - 1:])  # windows within one document
        new = np.r_[True, (selected[own[1:]] != selected[own[:-1]]) | (doc[own[1:]] != doc[own[:-1]])]
        low = own[new]
        count = np.diff(np.r_[np.flatnonzero(new), len(own)])
        place = selected[low]
        end = low + count + window - 1
        # the stretch: its words, and where in it the suffix starts
        stretch = mix(first.of(low, end) + mix(second.of(low, end) ^ (place - low).astype(U64)) + count.astype(U64))
        starts = np.cumsum(sizes) - sizes
        at, doc, by = low - starts[doc[low]], doc[low], order[place]
        sort = np.lexsort((at, stretch, by, doc))
        new = np.r_[True, (np.diff(doc[sort]) != 0) | (np.diff(by[sort]) != 0) | (np.diff(stretch[sort]) != 0)]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(sort)])
        more = [None] * len(first)
        for i in np.flatnonzero(size > 1):
            more[i] = at[sort[first[i] + 1: first[i] + size[i]]]
        rep = sort[first]
        return record(_SUFFIX, [by[rep].view(np.int64), stretch[rep].view(np.int64), np.array(ids, np.int64)[doc[rep]],
                                at[rep], count[rep], more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, held = [], [], 0
            for i, h in zip(batch.column(0).to_pylist(), _hashes(to_bytes(batch.column(1))), strict=True):
                if len(h) >= window:
                    ids.append(i)
                    hashes.append(h)
                    held += len(h)
                if held >= 300_000:
                    yield suffixes(ids, hashes)
                    ids, hashes, held = [], [], 0
            if ids:
                yield suffixes(ids, hashes)

    return docs.where("id IS NOT NULL").mapInArrow(released(run), _ddl(_SUFFIX))


def _stretches(docs: DataFrame, reps: DataFrame, window: int, span: int) -> DataFrame:
    """The representatives with their stretches' word hashes, in groups by prefix."""
    wanted = reps.groupBy("doc").agg(F.collect_list(F.struct("prefix", "stretch", "start", "n_windows", "n_classes")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, own, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                   _hashes(to_bytes(batch.column(2))), strict=True):
                rows += [(o["prefix"], 0, 0, span, o["prefix"], o["stretch"], doc, 0, o["n_windows"],
                          h[o["start"]: o["start"] + o["n_windows"] + window - 1].tobytes(), o["n_classes"]) for o in own
                         if o["start"] + o["n_windows"] + window - 1 <= len(h)]  # a repeated id's other text
            yield record(_SIZED, [list(c) for c in zip(*rows, strict=True)] or [[]] * len(_SIZED))

    return wanted.join(docs.withColumnRenamed("id", "doc"), "doc").mapInArrow(released(run), _ddl(_SIZED))


def _lengthened(groups: DataFrame, window: int, prefix: int) -> DataFrame:
    """Step 3, once: a group holds the suffixes that start ``low`` to ``high - 1`` words before the
    selected place.  Those of each half share ``window - size of the half + 1`` words, the new prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, low, high, p, s, d, first, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(words, U64)
                at = np.arange(len(h) - prefix + 1)
                place = int((RunningHash(h, _BASES[0]).of(at, at + prefix).view(np.int64) == p).argmax())
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle, high)) if high - low > 1 else ((low, high),):
                    begin, end = max(0, place - b + 1), min(n, place - a + 1)
                    if begin < end:
                        common = np.array([place - a]), np.array([place - b + 1 + window])
                        key, check = (int(mix(RunningHash(h, base).of(*common) + U64(a << 32 | b)).view(np.int64)[0])
                                      for base in _BASES[1:])
                        rows.append((key, check, a, b, p, s, d, first + begin, end - begin,
                                     words[8 * begin: 8 * (end + window - 1)]))
            yield record(_GROUP, [list(c) for c in zip(*rows, strict=True)] or [[]] * len(_GROUP))

    return groups.mapInArrow(released(run), _ddl(_GROUP))


def _sorted_suffixes(flat: np.ndarray, wanted: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``wanted`` in the order of the suffixes of ``flat`` there, and how many words each
    shares with the one before (0 for the first).  Prefix doubling; a stretch ends with a word of its
    own, so no two suffixes agree beyond it and none longer than ``longest`` words."""
    ranks, depth = [flat.astype(np.int32)], 1
    while depth < longest:
        rank = ranks[-1].astype(np.int64)
        behind = np.zeros_like(rank)
        behind[:-depth] = rank[depth:] + 1
        ranks.append(np.unique(rank * (len(rank) + 2) + behind, return_inverse=True)[1].astype(np.int32))
        depth *= 2
    order = wanted[np.argsort(ranks[-1][wanted], kind="stable")]
    left, right = order[:-1].copy(), order[1:].copy()
    for step in range(len(ranks) - 1, -1, -1):
        equal = ranks[step][left] == ranks[step][right]
        left[equal] += 1 << step
        right[equal] += 1 << step
    return order, np.r_[0, left - order[:-1]][: len(order)]


def _repeat_lengths(doc: np.ndarray, shared: np.ndarray, window: int) -> np.ndarray:
    """For sorted suffixes of the documents ``doc``, which share ``shared`` words with the one
    before: the depth of the deepest internal node above each that also holds a suffix of a
    smaller document; 0 where no such node has ``window`` words."""
    length = np.zeros(len(doc), np.int64)
    below, link = np.arange(len(doc)), shared  # suffixes below nodes of the depth reached
    for depth in np.unique(shared[shared >= window]):
        new = link < depth
        new[0] = True
        first, node = np.flatnonzero(new), np.cumsum(new) - 1
        smallest = np.minimum.reduceat(doc[below], first)
        length[below[smallest[node] < doc[below]]] = depth
        keep = (np.diff(np.r_[first, len(below)]) > 1)[node]
        below, link = below[keep], link[keep]
    return length


def _forest(rows: list[tuple], window: int) -> pa.RecordBatch:
    """Step 4: maximal repeats in the stretches ``rows``, whose groups are all here; as the runs of
    windows (first, n) that they cover."""
    prefix, stretch, doc, base, count = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[1:6])
    size = count + window - 1
    words = np.unique(np.frombuffer(b"".join(r[6] for r in rows), U64), return_inverse=True)[1]
    flat = np.insert(words, np.cumsum(size), words.max() + 1 + np.arange(len(rows)))  # ends of their own
    starts = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = starts[owner] + offset
    order, shared = _sorted_suffixes(flat, place, int(size.max()) + 1)
    suffix = np.empty(len(flat), np.int64)
    suffix[place] = np.arange(len(place))
    suffix = suffix[order]
    length = np.zeros(len(place), np.int64)
    length[suffix] = _repeat_lengths(doc[owner[suffix]], shared, window)
    goes_on = np.r_[False, (owner[1:] == owner[:-1]) & (length[:-1] == length[1:] + 1)]
    at = np.flatnonzero((length > 0) & ~goes_on)
    mine = owner[at]
    return record(_REPEAT, [prefix[mine], stretch[mine], base[mine] + offset[at], length[at] - (window - 1)])


def _trees(groups: DataFrame, window: int) -> DataFrame:
    """Groups are whole within a task; trees are built for some of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= FOREST_WORDS and row[0] != rows[-1][0]:
                    yield _forest(rows, window)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[6]) // 8
        if rows:
            yield _forest(rows, window)

    return groups.select("key", "prefix", "stretch", "doc", "first", "n_windows", "words").repartition(
        "key").sortWithinPartitions("key").mapInArrow(released(run), _ddl(_REPEAT))


def _repeats(groups: DataFrame, window: int, prefix: int, group_rows: int) -> DataFrame:
    """Steps 3 and 4.  Each step of 3 writes only what is still too large; there are as many as
    halvings of ``window - prefix + 1``."""
    fits, whole = F.col("n_rows") <= group_rows, F.col("high") == F.col("low") + 1
    trees, nodes = groups.where(fits), []
    large = groups.where(~fits)
    while large.limit(1).count():
        halves = scratch(_lengthened(large.select(*_GROUP.names), window, prefix), "halves")
        sized = halves.join(halves.groupBy("key").agg(F.count("*").alias("n_rows")), "key").select(*_SIZED.names)
        trees = trees.unionByName(sized.where(fits))
        nodes.append(sized.where(~fits & whole))
        large = sized.where(~fits & ~whole)
    repeats = _trees(trees, window)
    for node in nodes:  # the prefix is the window
        smallest = node.groupBy("key", "check").agg(F.min("doc").alias("smallest"))
        repeats = repeats.unionByName(node.join(smallest, ["key", "check"]).where("smallest < doc").select(
            "prefix", "stretch", "first", F.lit(1).alias("n")))
    return repeats


def repeated_spans(docs: DataFrame, window: int = 50, prefix: int = PREFIX, group_rows: int = GROUP_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans): for each document with repeats, the runs of words [start, end) to remove."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    suffixes = scratch(sparse_suffixes(rows, window, prefix), "suffixes")
    shared = suffixes.groupBy("prefix").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    shared = suffixes.join(shared.select("prefix"), "prefix")
    classes = shared.groupBy("prefix", "stretch").agg(F.min("doc").alias("smallest"))
    sizes = classes.groupBy("prefix").agg(F.count("*").alias("n_classes"))
    found = scratch(shared.join(classes, ["prefix", "stretch"]).join(sizes, "prefix"), "shared")

    own = found.where("doc = smallest AND n_classes > 1")
    reps = own.groupBy("prefix", "stretch", "doc", "n_windows", "n_classes").agg(F.min("start").alias("start"))
    groups = scratch(_stretches(rows, reps, window, window - prefix + 1), "stretches")
    repeats = _repeats(groups, window, prefix, group_rows)

    # a document's places of one stretch stay one row; spans are arrays until they meet by document
    places = F.concat(F.array("start"), F.coalesce("more", F.expr("array()")))

    def spans(first: F.Column, n: F.Column) -> F.Column:
        return F.transform("places", lambda s: F.struct(
            (s + first).alias("start"), (s + first + n + (window - 1)).alias("end"))).alias("spans")

    copies = found.where("doc > smallest").withColumn("places", places).select("doc", spans(F.lit(0), F.col("n_windows")))
    own = own.select("prefix", "stretch", "doc", places.alias("places"))
    others = own.join(repeats, ["prefix", "stretch"]).select("doc", spans(F.col("first"), F.col("n")))
    return copies.unionByName(others).groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """``docs`` with the columns n_words, n_removed and kept_text (its kept words joined by one
    space).  Columns of ``docs`` with those names are replaced."""
    spans = scratch(repeated_spans(docs, window, id_col=id_col, text_col=text_col, **options), "spans")
    docs = docs.drop("n_words", "n_removed", "kept_text")
    mine = docs.select(F.col(id_col).cast("long").alias("__doc"), F.struct(*docs.columns).alias("__row"))
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(to_bytes(batch.column(0).field(text_col)), batch.column(1).to_pylist(), strict=True):
                words, kept, at = text.split() if text else [], [], 0
                for cut in cuts or ():
                    kept += words[at: max(at, cut["start"])]
                    at = max(at, cut["end"])
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] or [
                pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__row", *schema.names])

    joined = mine.join(spans.withColumnRenamed("doc", "__doc"), "__doc", "left").select("__row", "spans")
    kind = joined.schema["__row"].dataType.simpleString()
    return joined.mapInArrow(released(run), f"__row {kind}, {_ddl(schema)}").select("__row.*", *schema.names)


def removal(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE: dict[str, str] = {}
