"""Semantic clusters of vectors with their places in the plane, and labels for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import identifier_words, title_case
from tessera.operators import density, layout
from tessera.operators.lineage import checkpointed

# Fixed value: words that do not name a cluster.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "get", "set", "has", "use", "can", "will", "not", "handle", "create", "update",
    "delete", "make", "build", "run", "init", "load", "check", "add", "remove", "fetch", "return", "async", "await",
)
LEAST_SNIPPETS = 4


def cluster_labels(members: DataFrame) -> DataFrame:
    """(cluster, label): the two most frequent words of the names, ties by word; `General` if there are none."""
    words = members.select("cluster", F.explode_outer(identifier_words(F.col("name"))).alias("word"))
    kept = words.withColumn("word", F.when(~F.col("word").isin(*STOP_WORDS), F.col("word")))
    counts = kept.groupBy("cluster", "word").agg(F.count("word").alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct((-F.col("n")).alias("n"), "word")))), 1, 2)
    best = counts.groupBy("cluster").agg(top.alias("top"))
    label = F.array_join(F.transform("top", lambda t: title_case(t["word"])), " & ")
    return best.select("cluster", F.when(F.size("top") > 0, label).otherwise("General").alias("label"))


def cluster_vectors(vectors: DataFrame, id_col: str, vector_col: str, min_cluster_size: int | None = None) -> DataFrame:
    """(id, cluster, x, y): a density cluster per vector, -1 for noise, and its place in the plane, scaled to [-1, 1] per axis.

    Rows as in ``density.numbered``; fewer than ``LEAST_SNIPPETS`` are noise in the middle."""
    rows = density.numbered(vectors, id_col, vector_col)
    if len(rows.take(LEAST_SNIPPETS)) < LEAST_SNIPPETS:
        return rows.select("id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    blocks = density.blocked(rows)
    near = checkpointed(density.neighbours(blocks, max(density.NEAR, layout.MOST_NEIGHBOURS)))
    clustered = density.density_clusters(vectors, min_cluster_size=min_cluster_size, blocks=(rows, blocks), near=near)
    xy = rows.select("n", "id").join(layout.laid_out(rows, blocks, near=near), "n").select("id", "x", "y")
    ends = xy.agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    scaled = [F.round((F.col(c) - F.col(f"{c}0")) / F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1e-6)) * 2 - 1, 4).alias(c) for c in "xy"]
    return xy.join(F.broadcast(ends)).join(clustered, "id").select("id", "cluster", *scaled)
