"""Retrieval on top of scored hits: quotas per collection, global cuts and score roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vector import top_k, top_k_per


def hot_hits(scored: DataFrame, collection: str, *tie: str, per_collection: int = 8, overall: int = 30) -> DataFrame:
    return top_k(top_k_per(scored, collection, per_collection, *tie), overall, *tie)


def clamp_top(n: int | None) -> int:
    return max(1, min(n or 10, 30))


def file_scores(hits: DataFrame, path: str = "file_path") -> DataFrame:
    named = hits.where(F.trim(F.coalesce(path, F.lit(""))) != "")
    return named.groupBy(F.trim(path).alias("file_path")).agg(F.sum("score").alias("score"))


def symbol_scores(hits: DataFrame, path: str = "file_path", klass: str = "class_name", function: str = "function_name") -> DataFrame:
    """By file and class, or function where there is no class."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    named = hits.select(blank(path).alias("file_path"), F.coalesce(blank(klass), blank(function)).alias("symbol"), "score")
    return named.where("file_path is not null and symbol is not null").groupBy("file_path", "symbol").agg(F.sum("score").alias("score"))


def compass_k(collections: int, top: int) -> int:
    return max(4, top // max(collections, 1))


def compass_hits(scored: DataFrame, collection: str, top: int, *tie: str) -> DataFrame:
    """Equal shares of ``top`` per collection, at least 4 each, then the best ``top`` overall."""
    n = scored.select(F.countDistinct(collection)).first()[0]
    return top_k(top_k_per(scored, collection, compass_k(n, top), *tie), top, *tie)


def concatenated(scored: DataFrame, collection: str, per_collection: int, head: int, *tie: str) -> DataFrame:
    """The best of each collection, collections one after the other, cut without sorting by score again."""
    best = top_k_per(scored, collection, per_collection, *tie)
    return best.orderBy(collection, "rank").limit(head)


def context_hits(scored: DataFrame, collection: str, target: object, top: int, others: int, *tie: str) -> DataFrame:
    """``top`` of the target collection and ``others`` of every other one."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(collection).orderBy(F.desc("score"), *tie)))
    mine: Column = F.col(collection) == F.lit(target)
    return ranked.where(F.when(mine, F.col("rank") <= top).otherwise(F.col("rank") <= others))


def hit_paths(hits: DataFrame, path: str = "file_path") -> DataFrame:
    """Distinct paths without blanks; kept as rows, since a result set can be large."""
    return hits.select(F.trim(path).alias("file_path")).where("file_path != ''").distinct()
