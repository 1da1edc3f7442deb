"""Connected components by alternating large-star / small-star rounds, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, gathered, swept


def _state(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set: one row, whatever the size."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in an edge between two different nodes.

    ``root`` is the smallest node reachable. Edges with a null end and self loops are ignored;
    repeated and reversed edges count once. Each round moves O(edges) rows, sums per node are
    combined before the shuffle, and the edge set is checkpointed so that lost executors cost
    one round only. A round has no more tasks than its edges fill.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before = _state(e)
    while before[0]:
        few = lambda df, n=before[0]: gathered(df, n)
        e = few(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            few(both.join(least, "u"))
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        large = few(large)
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = few(large.join(parent, "u")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(few(moved.unionByName(few(parent.select("u", F.col("m").alias("v")))).distinct()))
        after = _state(e)
        if after == before:
            break
        before = after
    swept(edges.sparkSession)
    few = lambda df, n=before[0]: gathered(df, n)
    stars = few(e.groupBy("u").agg(F.min("v").alias("root"))).select(F.col("u").alias("node"), "root")
    return stars.unionByName(few(stars.select(F.col("root").alias("node"), "root").distinct()))
