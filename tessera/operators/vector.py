"""Vector store operations: similarity, top k overall and per group, upserts, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import repo_label, repo_slug, repo_token, uuid5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length 1, as doubles; null for a zero vector. Normalise once, then similarity is a dot product."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def similar_to(vectors: DataFrame, query: DataFrame, vector_col: str, query_col: str = "q") -> DataFrame:
    """``vectors`` with a ``score`` against the single vector of ``query`` (one row, so it can be broadcast)."""
    one = query.select(F.col(query_col).alias("_q")).limit(1)
    return vectors.join(F.broadcast(one)).withColumn("score", cosine(F.col(vector_col), F.col("_q"))).drop("_q").where("score is not null")


def top_k(scored: DataFrame, k: int, *tie: str, where: dict[str, object] | None = None) -> DataFrame:
    """The ``k`` highest scores; the condition on payload fields reaches the scan."""
    for name, value in (where or {}).items():
        scored = scored.where(F.col(name) == F.lit(value))
    return scored.orderBy(F.desc("score"), *tie).limit(k)


def top_k_per(scored: DataFrame, group: str, k: int | Column, *tie: str) -> DataFrame:
    """The ``k`` highest scores of each group. A literal bound lets Spark cut each group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert_points(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the highest ``order``."""
    both = old.unionByName(new)
    fields = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("p")).select(key, "p.*")


def point_id(chunk_id: Column) -> Column:
    return uuid5(chunk_id)


def organization_matches(short_id: Column, asked: str) -> Column:
    """Blanks, an `org-` prefix and case do not count."""
    clean = lambda c: F.lower(F.regexp_replace(F.trim(c), "^org-", ""))
    return clean(short_id) == clean(F.lit(asked))


def collections_for(collections: DataFrame, asked: list[str], name: str = "name", by_label: bool = False) -> DataFrame:
    """Collections whose repository equals or contains one that is asked for; all, if none does or none is asked for."""
    spark = collections.sparkSession
    tokens = [t for t in asked if t and t.strip()]
    if not tokens:
        return collections
    wanted = spark.createDataFrame([(t,) for t in tokens], "t string").select(repo_token(F.col("t"), not by_label).alias("t")).where("t != ''").agg(F.collect_set("t").alias("_wanted"))
    segment = repo_token(repo_label(F.col(name)), False) if by_label else repo_slug(F.col(name))
    marked = collections.join(F.broadcast(wanted)).withColumn("_hit", F.exists("_wanted", lambda t: F.contains(segment, t)))
    found = marked.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_any"))
    return marked.join(F.broadcast(found)).where("_hit or not _any").drop("_wanted", "_hit", "_any")
