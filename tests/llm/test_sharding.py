import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalspark.llm import sharding
from evalspark.session import scratch_path
from tests.llm.conftest import DOCUMENTS


def check(rows, texts, shards=16):
    """Every row placed once with its size and checksum; slots gapless in each shard."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))
    loads = Counter({s: 0 for s in range(shards)})
    for r in rows:
        loads[r["shard"]] += r["size"]
    return loads


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_query_rows(spark):
    sf = "/root/testdata/sf0.01"
    loads = check(sharding.op13_sharding(spark, sf).collect(), texts_of(spark.read.parquet(f"{sf}/documents.parquet")))
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 16


@pytest.mark.parametrize("make", ["same id", "same row", "null text"])
def test_a_third_of_all_rows_in_one_place(spark, make):
    rows = [(i, f"text {i} " * (i % 7 + 1), None, None, None) for i in range(4000)]
    hot = {"same id": lambda i: (77, f"hot {i} " * 3), "same row": lambda i: (77, "hot " * 5), "null text": lambda i: (None, None)}[make]
    rows += [(*hot(i), None, None, None) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(7)
    loads = check(sharding.shard_by_bytes(docs, slots=512).collect(), [r[:2] for r in rows])
    assert max(loads.values()) <= 1.02 * sum(loads.values()) / 16


def test_same_rows_same_shards(spark):
    """The placement depends on the rows alone, not on how they are dealt over partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ({(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(docs.repartition(n)).collect()} for n in (2, 9))
    assert one == two


def test_versions_and_growth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.scratch(sharding.records(docs), "records")
    keyed, sizes = sharding.slot_sizes(rows, 16)
    maps = sharding.SlotMaps(spark, scratch_path(spark, "maps"))
    first = sharding.even_map(sizes, 16)
    maps.store(0, 16, sizes, first)
    second = sharding.rebalanced(sizes, first, 16)
    maps.store(1, 16, sizes, second)
    third = sharding.grown(sizes, second, 16)
    maps.store(2, 17, sizes, third)
    moved = {k for k in second if third[k] != second[k]}
    assert moved and all(third[k] == 16 for k in moved)  # rows move into the new shard only
    placed = [sharding.place(keyed, maps.read(v), 17).withColumnRenamed("id", "doc_id") for v in (1, 2)]
    loads = [check(p.collect(), texts_of(docs), 17) for p in placed]
    fair = sum(loads[1].values()) / 17
    assert loads[0][16] == 0 and abs(loads[1][16] - fair) < 0.1 * fair
    assert maps.read(0).where(F.col("shard") != F.col("virtual_slot") % 16).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        maps.store(1, 16, sizes, first)


def test_awkward_and_empty(spark, awkward, nothing):
    wide = awkward.withColumn("size", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("id", F.lit(2))
    check(sharding.shard_by_bytes(wide).collect(), texts_of(awkward))
    assert sharding.shard_by_bytes(nothing).collect() == []
