"""Operator 13: shards over fixed virtual slots.

Records are hashed into a fixed number of slots, once and for all; only the table that maps
slots to shards ever changes.  Rows and bytes are summed per slot; the map is edited by moving
slots from the fullest to the emptiest shards until their sizes are near equal, and each edit is
stored as a new version, so that every earlier placement can be read again.  Growing by shards
is such an edit too: slots move into the new shards only.

One slot may hold far too much (an id that a third of all rows repeat): a slot with more than a
``SHARE``-th of a fair share of the bytes or of the rows is split by a second hash (of id and
text), and what is still too large by a third (of the place of the row in the written table, so
that even equal rows part).  Parts are entries of the map of their own.  No more than
shards x SHARE slots can exceed the bound, so the map has a bounded number of entries.

Defined results: size is the UTF-8 bytes of the text and one more (NULL: one), so no row weighs
nothing; a NULL id is a key like any other; repeated rows are placed one by one; other columns
play no part.  A single row above a shard's fair share stays whole."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import scratch, table
from evalspark.session import scratch_path

SLOTS = 4096
#: Parts that a slot above the bound is split into, and what part of a fair share the bound is.
PARTS, SHARE = 64, 32

#: An entry of the map: a slot, and the parts of a split one (-1: not split).
KEY = ["virtual_slot", "part", "sub_part"]


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot, second, third): all that placing a row needs."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.length(data) + 1).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))

    def spread(*columns: str, seed: int, by: int) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(by)).cast("int")

    return rows.select("id", "size", "text_crc32", spread("id", seed=1, by=slots).alias("virtual_slot"),
                       spread("id", "text_crc32", "size", seed=2, by=PARTS).alias("second"),
                       spread("place", seed=3, by=PARTS).alias("third"))


def slot_sizes(rows: DataFrame, shards: int) -> tuple[DataFrame, list[tuple]]:
    """The rows with the key of their map entry, and [(key, bytes, rows)] of all entries.  What
    reaches the driver is bounded by slots + 2 x shards x SHARE x PARTS entries."""
    keyed = rows.withColumn("part", F.lit(-1)).withColumn("sub_part", F.lit(-1))
    sizes = _sizes(keyed)
    limits = [sum(x) // (shards * SHARE) for x in zip(*((b, n) for _, b, n in sizes), strict=True)] or [0, 0]
    for column, source in (("part", "second"), ("sub_part", "third")):
        large = [key for key, held, n in sizes if n > 1 and (held > limits[0] or n > limits[1]) and key[-1] == -1
                 and (column == "part" or key[1] >= 0)]
        if not large:
            break
        marked = rows.sparkSession.createDataFrame([(*key, True) for key in large],
                                                   "virtual_slot int, part int, sub_part int, large boolean")
        keyed = keyed.join(marked, KEY, "left").withColumn(
            column, F.when(F.col("large"), F.col(source)).otherwise(F.col(column))).drop("large")
        sizes = _sizes(keyed)
    return keyed, sizes


def _sizes(keyed: DataFrame) -> list[tuple]:
    sums = keyed.groupBy(*KEY).agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    return sorted(((r["virtual_slot"], r["part"], r["sub_part"]), r["held"], r["n"]) for r in sums.collect())


def even_map(sizes: list[tuple], shards: int) -> dict[tuple, int]:
    """Version 0: slots dealt round; parts of a split slot stand where the slot stands."""
    return {key: key[0] % shards for key, _, _ in sizes}


class _Loads:
    """Entries per shard, sorted by size, and the shards' loads."""

    def __init__(self, sizes: dict[tuple, int], placed: dict[tuple, int], shards: int):
        self.of = [sorted((sizes[k], k) for k, s in placed.items() if s == shard) for shard in range(shards)]
        self.load = [sum(b for b, _ in x) for x in self.of]

    def move(self, entry: tuple, source: int, target: int) -> None:
        self.of[source].remove(entry)
        insort(self.of[target], entry)
        self.load[source] -= entry[0]
        self.load[target] += entry[0]

    def nearest(self, shard: int, size: float, below: float) -> tuple | None:
        """The shard's entry whose size is closest to ``size``, under ``below``."""
        at = bisect_left(self.of[shard], (size,))
        near = [e for e in self.of[shard][max(at - 1, 0): at + 1] if 0 < e[0] < below]
        return min(near, key=lambda e: abs(e[0] - size), default=None)


def rebalanced(sizes: list[tuple], placed: dict[tuple, int], shards: int) -> dict[tuple, int]:
    """The map with as few entries moved as a steady choice allows: from the fullest to the
    emptiest shard goes the entry closest to half of what parts them; where no move helps, two
    entries change places; it ends when neither brings the two closer."""
    weight = {key: held for key, held, _ in sizes}
    loads = _Loads(weight, placed, shards)
    while True:
        high, low = (pick(range(shards), key=lambda s: (loads.load[s], s)) for pick in (max, min))
        apart = loads.load[high] - loads.load[low]
        entry = loads.nearest(high, apart / 2, apart)
        if entry and abs(apart - 2 * entry[0]) < apart * 0.9:
            loads.move(entry, high, low)
            continue
        best = None
        for back in loads.of[low]:
            give = loads.nearest(high, back[0] + apart / 2, back[0] + apart)
            if give and give[0] > back[0] and (best is None or abs(apart - 2 * (give[0] - back[0])) < best[0]):
                best = (abs(apart - 2 * (give[0] - back[0])), give, back)
        if entry and (best is None or abs(apart - 2 * entry[0]) <= best[0]):
            best = (abs(apart - 2 * entry[0]), entry, None)
        if best is None or best[0] >= apart:
            break
        loads.move(best[1], high, low)
        if best[2]:
            loads.move(best[2], low, high)
    return {key: shard for shard, held in enumerate(loads.of) for _, key in held}


def grown(sizes: list[tuple], placed: dict[tuple, int], shards: int) -> dict[tuple, int]:
    """The map for one more shard: entries of the fullest shards move into it, nothing else moves,
    until it holds a fair share."""
    weight = {key: held for key, held, _ in sizes}
    loads = _Loads(weight, placed, shards + 1)
    fair = sum(loads.load) / (shards + 1)
    while True:
        high = max(range(shards), key=lambda s: (loads.load[s], s))
        lack = fair - loads.load[shards]
        entry = loads.nearest(high, min(lack, loads.load[high] - fair), 2 * lack)
        if entry is None:
            break
        loads.move(entry, high, shards)
    return {key: shard for shard, held in enumerate(loads.of) for _, key in held}


class SlotMaps:
    """Versions of the slot map in a folder that all executors reach; none is ever overwritten."""

    SCHEMA = "version int, shards int, virtual_slot int, part int, sub_part int, shard int, held long, n long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def store(self, version: int, shards: int, sizes: list[tuple], placed: dict[tuple, int]) -> DataFrame:
        rows = [(version, shards, *key, placed[key], held, n) for key, held, n in sizes]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("errorifexists").parquet(self._path(version))
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self._path(version))

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:06d}"


def place(keyed: DataFrame, slot_map: DataFrame, shards: int) -> DataFrame:
    """(id, size, text_crc32, shard, slot, virtual_slot, version): ``slot`` counts a shard's rows
    from 0.  Rows are numbered inside their map entry, behind all rows of the entries before it."""
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(*KEY)) - F.col("n")
    entries = slot_map.select(*KEY, "shard", "version", before.alias("before"))  # bounded: one row an entry
    inside = F.row_number().over(Window.partitionBy(*KEY).orderBy("id", "text_crc32", "size", "third"))
    numbered = keyed.withColumn("inside", inside)
    return numbered.join(entries, KEY).select(
        "id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"), "virtual_slot", "version")


def shard_by_bytes(docs: DataFrame, shards: int = 16, slots: int = SLOTS, folder: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard under the rebalanced map (version 1; version 0 is the even deal)."""
    spark = docs.sparkSession
    rows = scratch(records(docs, slots, id_col, text_col), "records")
    keyed, sizes = slot_sizes(rows, shards)
    maps = SlotMaps(spark, folder or scratch_path(spark, "slot-maps"))
    first = even_map(sizes, shards)
    maps.store(0, shards, sizes, first)
    current = maps.store(1, shards, sizes, rebalanced(sizes, first, shards))
    return place(keyed, current, shards).withColumnRenamed("id", id_col)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


QUERIES = {"op13_sharding": op13_sharding}
ORACLE: dict[str, str] = {}
