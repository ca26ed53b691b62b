"""Operator 4: n-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

Documents are sets of distinct word shingles; two link if the Jaccard similarity of their sets
is at least ``percent`` / 100.  Equal sets are one class from the start.  The result is the
component of every document under links.  Links between copies or inside a component already
found are not enumerated, but no link between different components is lost:

1. *Profiles.*  One pass gives each set's size, 128-bit hash, bitmap signature (four bits and more
   per shingle) and a few minima under independent hashes.
2. *Stars.*  Classes that share a minimum in the same or the next size band form a tile.  Every
   member is paired with the tile's first document only; the bitmap bound, then the exact
   intersection decide.  This joins the bulk of near copies at linear cost.
3. *Completion (exact).*  If two sets link, they share a shingle among the first
   ``n - ceil(0.8 n) + 1`` of each, in any fixed order of shingles; here rare shingles come first,
   by counts of all shingles in a table of fixed size.  Documents that share such a shingle,
   are in compatible size bands and in different components meet in a tile.  A large tile is
   cut into chunks, bounded by rows and by bytes, and the chunks meet in pairs.  Signatures bound the overlap from above:
   bits of A that B lacks are shingles that B lacks.  A pair is a candidate in one tile only,
   that of its smallest shared token.  Survivors are verified exactly.

Defined results: documents without words or text have an empty set and are linked with
nothing; fewer words than a shingle are one shingle; rows with a NULL id link with nothing and
have a NULL component; an id given to several texts is one document that links by any of
them; other columns play no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import U64, bound_batches, mix, nonempty, record, released, scratch, table, to_bytes, word_hashes
from evalspark.llm.graph import components

SHINGLE = 5
PERCENT = 80
#: Minima under independent hashes, for the stars.
MINIMA = 6
#: Entries of the table of shingle counts (it fixes the order of shingles only), and the blocks
#: in which tasks' tables are added up.
COUNTERS = 1 << 20
BLOCKS = 64
#: Classes, and bytes of their bitmaps and tokens, in one chunk of a tile.
CHUNK_ROWS = 2000
CHUNK_BYTES = 8 << 20
#: 64-bit words of bitmaps gathered at a time.
TILE_WORDS = 200_000
#: Members of one star that are verified in one task.
STAR_ROWS = 1000

_BASE = U64(0x9E3779B97F4A7C15)
_SALTS = np.random.default_rng(4).integers(0, 1 << 63, 64, np.int64).view(U64)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; ASCII letters are lower-cased."""
    words = text.lower().split() if text else []
    h = word_hashes(words, len(words))
    k = min(size, len(h))
    if not k:
        return h
    out = np.zeros(len(h) - k + 1, U64)
    for i in range(k):
        out = out * _BASE + mix(h[i: len(h) - k + 1 + i])
    return np.unique(mix(out + U64(k)))


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap with a bit for each shingle, four times as wide as there are, or wider (a power of
    two, so that bitmaps of other widths can be folded)."""
    width = max(64, 1 << max(0, 4 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> U64(20)) & U64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A wider bitmap (rows of 64-bit words) at a smaller width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes na, nb with bitmaps a, b can reach the similarity."""
    overlap = np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64),
                         nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return (100 + percent) * overlap >= percent * (na + nb)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _profiles(docs: DataFrame, size: int, minima: int) -> DataFrame:
    """Step 1: a row per document (block NULL), and per task its shingle counts in blocks."""
    ddl = "id long, n long, h1 long, h2 long, minima array<long>, bits binary, block int"
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary(), pa.int32()]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["id", "n", "h1", "h2", "minima", "bits", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1)), strict=True):
                s = shingle_set(text, size)
                np.add.at(counts, _counter(s), 1)
                low = [int(mix(s ^ salt).min().view(np.int64)) for salt in _SALTS[:minima]] if len(s) else []
                rows.append((i, len(s), *_set_hash(s), low, signature(s), None))
            yield rows_of(rows)
        yield rows_of([(None,) * 5 + (part.tobytes(), k) for k, part in enumerate(counts.reshape(BLOCKS, -1))])

    return docs.mapInArrow(released(run), ddl)


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> U64(44)).astype(np.int64)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s), mix(s ^ _SALTS[-1])
    return tuple(int(mix(np.array([x + U64(len(s))], U64)).view(np.int64)[0]) for x in
                 (a.sum(dtype=U64), b.sum(dtype=U64)))


def _shingle_counts(profiles: DataFrame) -> np.ndarray:
    """The table of counts over all documents; its size is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(
            [x.tobytes() for x in sums.values()], pa.binary())], names=["block", "bits"])

    parts = profiles.where("block IS NOT NULL").select("block", "bits").repartition(BLOCKS, "block")
    got = {r["block"]: np.frombuffer(r["bits"], np.int64) for r in parts.mapInArrow(add, "block int, bits binary").collect()}
    return np.concatenate([got[k] for k in range(BLOCKS)]) if got else np.zeros(COUNTERS, np.int64)


def _band(n: str, percent: int) -> F.Column:
    """Sets that can link are in the same or adjacent bands."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                width = min(len(x), len(y))
                keep[i] = may_link(fold(x, width), na[i], fold(y, width), nb[i], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    return pairs.where(fits).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(released(run), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection.  Pairs are gathered by ``a`` (and a salt,
    so that no task has all members of a large star).  A text travels once for each of its roles;
    the join on ids is free to split an id with very many of them."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).alias("cuts"))
    pairs = pairs.join(sizes, "a").select("a", "b", F.pmod("salt", "cuts").alias("cut"))
    first = pairs.select("a", "cut").distinct().select(F.col("a").alias("id"), "a", "cut", F.lit(0).alias("role"))
    roles = pairs.select(F.col("b").alias("id"), "a", "cut", F.lit(1).alias("role")).unionByName(first)
    sent = docs.join(roles, "id").select("a", "cut", "role", "id", "text")
    sent = sent.repartition("a", "cut").sortWithinPartitions("a", "cut", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            out = []
            for a, cut, role, i, text in zip(*(batch.column(c).to_pylist() for c in range(4)),
                                             to_bytes(batch.column(4)), strict=True):
                if at != (a, cut):
                    at, heads = (a, cut), []
                s = shingle_set(text, size)
                if not role:
                    heads.append(s)
                elif any(links(h, s, percent) for h in heads):
                    out.append((a, i))
            yield record(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [[x[0] for x in out], [x[1] for x in out]])

    return sent.mapInArrow(released(run), "a long, b long").distinct()


def _stars(classes: DataFrame, percent: int) -> DataFrame:
    """Step 2: pairs (first document of a tile, member)."""
    rows = classes.select("rep", _band("n", percent).alias("band"), F.posexplode("minima").alias("i", "low"))
    rows = rows.select("rep", "i", "low", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    first = rows.groupBy("i", "low", "band").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").drop("z")
    return rows.join(first, ["i", "low", "band"]).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def _postings(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """Step 3: (token, doc) for the first shingles of each set, rare ones first.  One copy of a
    set stands for the others that a task sees."""
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1).astype(U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, order = set(), sent.value
        for batch in batches:
            tokens, ids, many = [np.zeros(0, U64)], [], []
            for i, text in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1)), strict=True):
                s = shingle_set(text, size)
                if not len(s) or (key := _set_hash(s)) in seen:
                    continue
                seen.add(key)
                n = len(s) - -(-percent * len(s) // 100) + 1
                rank = (order[_counter(s)] << U64(40)) | (s & U64((1 << 40) - 1))
                tokens.append(s[np.argsort(rank, kind="stable")[:n]])  # equal ranks: by value, as s is sorted
                ids.append(i)
                many.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)),
                                              pa.array(np.repeat(np.array(ids, np.int64), many))], names=["token", "id"])

    return docs.where("id IS NOT NULL").mapInArrow(released(run), "token long, id long")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings whose token stands in more than one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # token before, and a row whose successor isn't known yet
        for batch in nonempty(batches):
            token, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held is not None:
                token, i = np.r_[held[0], token], np.r_[held[1], i]
            same = token[1:] == token[:-1]
            keep = np.r_[same, False] | np.r_[last is not None and token[0] == last, same]
            if len(token) > 1:
                last = token[-2]
            held = (token[-1], i[-1])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(i[keep])], names=["token", "id"])
        if held is not None and held[0] == last:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], names=["token", "id"])

    return postings.repartition("token").sortWithinPartitions("token").mapInArrow(released(run), "token long, id long")


def _tiles(rows: DataFrame, classes: DataFrame, percent: int, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (token, rep, comp) in different components.

    A chunk is bounded by rows and by bytes.  A row carries those of its set's tokens that are
    smaller than the tile's: sets that share one of them met in that one's tile."""
    held = rows.groupBy("rep").agg(F.sort_array(F.collect_list("token")).alias("tokens"))  # a set's own prefix
    rows = rows.join(classes.select("rep", "n", "bits"), "rep").join(held, "rep").withColumn("band", _band("n", percent))
    weight = F.size("tokens") * 4 + F.length("bits") + 64  # half of the tokens, on average
    chunks = rows.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / chunk_rows), F.ceil(F.sum(weight) / chunk_bytes)).alias("chunks"))
    rows = rows.join(chunks, "token").withColumn("mine", F.pmod(F.xxhash64("rep"), "chunks"))
    rows = rows.withColumn("smaller", F.slice("tokens", F.lit(1), (F.array_position("tokens", F.col("token")) - 1).cast("int")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.withColumn("low", F.explode(F.array("band", F.col("band") - 1)))
    rows = rows.select("token", "low", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                       "mine", "band", "rep", "comp", "n", "bits", "smaller")
    tile = ["token", "low", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _tile_parts(batches):
            if sum(map(len, parts)) > 1:
                for a, b in _tile_pairs(key, pa.Table.from_batches(parts).combine_chunks(), percent):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()),
                                                      pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(released(run), "a long, b long").distinct()


def _tile_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The rows of each tile (equal in the first four columns), as slices of the sorted batches."""
    key, parts = None, []
    for batch in nonempty(batches):
        columns = [batch.column(c).to_numpy() for c in range(4)]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for low, high in zip([0, *edges], [*edges, len(batch)], strict=True):
            here = tuple(int(c[low]) for c in columns)
            if key != here:
                if key is not None:
                    yield key, parts
                key, parts = here, []
            parts.append(batch.slice(low, high - low))
    if key is not None:
        yield key, parts


def _tile_pairs(key: tuple, tile: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a tile that may link and share no smaller token, in pieces."""
    mine, band, rep, comp, n = (tile.column(c).to_numpy() for c in range(4, 9))
    bits = [np.frombuffer(x.as_buffer(), U64) for x in tile.column(9).chunk(0)]
    lists = tile.column(10).chunk(0)
    tokens, at = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    width = min(map(len, bits))
    bits = np.array([fold(x, width) for x in bits])
    for k in range(0, len(rep), 32):
        x = slice(k, k + 32)
        ok = (comp[x, None] != comp) & (100 * np.minimum(n[x, None], n) >= percent * np.maximum(n[x, None], n))
        ok &= (band[x, None] == key[1]) & ((band > key[1]) | (rep[x, None] < rep))  # each pair of bands once
        if key[2] != key[3]:
            ok &= mine[x, None] != mine
        p, q = np.nonzero(ok)
        p += k
        step = max(1, TILE_WORDS // width)  # bitmaps of so many pairs are compared at a time
        ok = np.concatenate([may_link(bits[p[i: i + step]], n[p[i: i + step]], bits[q[i: i + step]], n[q[i: i + step]], percent)
                             for i in range(0, max(1, len(p)), step)])
        p, q = p[ok], q[ok]
        for row in np.unique(p):
            met = q[p == row]
            met = met[_disjoint(tokens[at[row]: at[row + 1]], tokens, at, met)]
            if len(met):
                yield np.full(len(met), rep[row]), rep[met]


def _disjoint(own: np.ndarray, tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the rows' token lists (tokens[at[r]:at[r + 1]]) share nothing with the sorted ``own``."""
    sizes = at[rows + 1] - at[rows]
    if not len(own) or not sizes.any():
        return np.ones(len(rows), bool)
    start = np.cumsum(sizes) - sizes
    flat = tokens[np.arange(sizes.sum()) + np.repeat(at[rows] - start, sizes)]
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    shared = np.r_[0, np.cumsum(hit)]
    return shared[start + sizes] == shared[start]


def _classes(docs: DataFrame, size: int, minima: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, members): equal sets are one class, named by its smallest id."""
    profiles = scratch(_profiles(docs, size, minima), "profiles")
    linkable = profiles.where("block IS NULL AND n > 0 AND id IS NOT NULL")
    classes = scratch(linkable.groupBy("h1", "h2", "n", "minima", "bits").agg(F.min("id").alias("rep")), "classes")
    members = scratch(linkable.select("id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(
        "id", "rep").distinct(), "members")
    return profiles, classes, members


def _candidates(docs: DataFrame, profiles: DataFrame, classes: DataFrame, where: DataFrame, size: int, percent: int,
                chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a prefix shingle and may link.
    ``where`` has the class and component (id, rep, comp) of every document."""
    postings = _shared(_postings(docs, _shingle_counts(profiles), size, percent))
    found = scratch(postings.join(where, "id").select("token", "rep", "comp").distinct(), "postings")
    # tokens of one shared passage stand in the same sets: one of them is enough for a tile
    mixed = found.groupBy("token").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("many"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    mixed = mixed.where("low < high").groupBy("many", "low", "high", "x", "y").agg(F.min("token").alias("token"))
    found = scratch(found.join(mixed.select("token"), "token"), "mixed")
    return scratch(_tiles(found, classes, percent, chunk_rows, chunk_bytes), "pairs")


def jaccard_pairs(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk_rows: int = CHUNK_ROWS,
                  chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: (a, b) for every two classes of equal sets that link, a < b, and (id, rep),
    the class of every document.  Every link is evaluated; copies are not expanded into pairs."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles, classes, members = _classes(rows, size, 0)
    where = members.withColumn("comp", F.col("rep"))
    pairs = _candidates(rows, profiles, classes, where, size, percent, chunk_rows, chunk_bytes)
    return scratch(_verified(pairs, rows, size, percent), "links"), members


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, rep, n_links): how many documents with other texts or copies of its own a document
    links with: the sizes of the linked classes, and the other members of its class."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("copies").alias("linked"))
    counted = members.join(sizes, "rep").join(linked, F.col("rep") == F.col("a"), "left")
    return counted.select("id", "rep", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, minima: int = MINIMA,
                       chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles, classes, members = _classes(rows, size, minima)
    sets = profiles.where("block IS NULL")

    stars = _bounded(_stars(classes, percent), classes, percent)
    star_links = scratch(_verified(stars, rows, size, percent), "star-links")
    # an id in several classes (given to several texts) joins them
    same_id = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    label = components(star_links)

    def component(frame: DataFrame) -> DataFrame:  # adds comp to rows with a rep
        found = label.select(F.col("node").alias("rep"), F.col("root").alias("comp"))
        return frame.join(found, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    where = scratch(component(members), "where")
    pairs = _candidates(rows, profiles, classes, where, size, percent, chunk_rows, chunk_bytes)
    late_links = scratch(_verified(pairs, rows, size, percent), "late-links")

    edges = star_links.unionByName(late_links).unionByName(same_id)
    label = components(edges).select(F.col("node").alias("id"), "root")
    smallest = label.groupBy("root").agg(F.min("id").alias("component_id"))
    label = label.join(smallest, "root").select("id", "component_id")
    return sets.select("id", F.col("n").alias("n_shingles")).join(label, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE: dict[str, str] = {}
