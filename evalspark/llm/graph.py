"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import scratch


def _rank(column: str) -> F.Column:
    """Nodes are ordered by a hash first, so that no numbering of a graph makes long chains."""
    return F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root names the component.

    Each round hooks every node to its best neighbour or itself, follows the hooks twice, and
    replaces nodes by what they reached; edges within one node vanish.  Rounds grow with the
    logarithm of the longest path.  Edges are written once a round, so lineage stays short."""
    edges = scratch(edges.select("a", "b").where("a <> b").distinct(), "edges")
    label = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_rank("b")).alias("best"))
        hook = best.select(F.col("a").alias("node"), F.least("best", _rank("a"))["id"].alias("root"))
        for _ in range(2):
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            hook = hook.join(up, "root").select("node", F.col("up").alias("root"))
        hook = scratch(hook, "hooks")
        if label is None:
            label = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            label = scratch(label.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        ends = [hook.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        edges = scratch(edges.join(ends[0], "a").join(ends[1], "b").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
