"""Memory of a task that writes or searches many segments of the positional index."""
import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from evalspark.llm import decontaminate as d


def test_written_index_closes_row_groups_by_bytes_not_by_rows(spark):
    text = F.expr("array_join(transform(sequence(1, 400000), x -> concat('w', doc_id, 'x', x)), ' ')")
    docs = spark.range(6, numPartitions=1).withColumnRenamed("id", "doc_id").withColumn("text", text)
    index = d.build_index(docs, segment_words=400_000)
    files = [pq.ParquetFile("/" + f.removeprefix("file:").lstrip("/")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 6 and max(g.total_byte_size for g in groups) < 24 << 20
    items = spark.createDataFrame([(1, "w5x399990 " + " ".join(f"w5x{i}" for i in range(399_991, 400_001)))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in d.contamination(docs, items).collect()}
    assert got == {i: (400_000, 11 * (i == 5)) for i in range(6)}


def test_portions_of_a_search_are_bounded_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [[b"abc"[x:x + 1] for x in rng.integers(0, 3, 300)] for _ in range(4)]
    hashes = [d.word_hashes(t, len(t)) for t in texts]
    segment = d._segment(0, list("wxyz"), hashes, d.GAP)
    starts, terms, first, steps = (segment.column(c)[0].values.to_numpy(zero_copy_only=False) for c in range(3, 7))
    windows = d.Windows([(str(i), b" ".join(texts[i][i:i + 40])) for i in range(4)] + [("5", b"a b")], 4)
    positions = np.cumsum(steps, dtype=np.int64)

    def run():
        return list(d._search(windows, terms.view(np.uint64), first, positions, 0))

    whole = run()
    assert len(whole) == 1
    seen, repeat = [], np.repeat
    monkeypatch.setattr(d, "SEARCH_STARTS", 500)
    monkeypatch.setattr(d, "SEARCH_WINDOWS", 11)
    monkeypatch.setattr(d.np, "repeat", lambda x, n: seen.append(len(r := repeat(x, n))) or r)
    parts = run()
    assert max(seen[1:]) <= 500 < sum(seen[1:]) / 2
    want = {*zip(*(x.tolist() for x in whole[0]), strict=True)}
    got = [p for w, at in parts for p in zip(w.tolist(), at.tolist(), strict=True)]
    assert len(got) == len(want) and {*got} == want
    flat = {(i, int(starts[t]) + s) for i in range(len(windows.lengths)) for t, h in enumerate(hashes) for s in range(len(h))
            if (n := int(windows.lengths[i])) and s + n <= len(h) and (h[s:s + n] == windows.terms[i, :n]).all()}
    assert want == flat
