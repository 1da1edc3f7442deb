"""Snapshot differences and what they make stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heads(rows: DataFrame, column: str = "heads", *keys: str) -> DataFrame:
    """(keys…, branch, sha) from a map of heads."""
    return rows.select(*keys, F.explode(column).alias("branch", "sha"))


def changed_heads(stored: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """(keys…, branch, sha, old_sha): branches that are new or moved. Deleted branches are left out."""
    old = stored.select(*keys, "branch", F.col("sha").alias("old_sha"))
    return current.join(old, [*keys, "branch"], "left").where(~F.col("sha").eqNullSafe(F.col("old_sha")))


def changed_files(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(keys…, path): files added, removed or with other content, compared by content hash."""
    o = old.select(*keys, "path", F.sha2("content", 256).alias("_o"))
    n = new.select(*keys, "path", F.sha2("content", 256).alias("_n"))
    return o.join(n, [*keys, "path"], "full_outer").where(~F.col("_o").eqNullSafe(F.col("_n"))).select(*keys, "path")


def stale(documents: DataFrame, changed: DataFrame, key: str = "id", paths: str = "file_paths", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``documents`` that use a changed path. Null and empty lists use none.

    An equi-join on the exploded paths: the changed set may be of any size.
    """
    used = documents.select(key, *by, F.explode(paths).alias("path")).where("path is not null")
    hit = used.join(changed.select(*by, "path").distinct(), [*by, "path"], "left_semi").select(key).distinct()
    return documents.join(hit, key, "left_semi")


def advance(stored: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """All current heads, and those stored of repositories that do not occur now."""
    rest = stored.join(current.select(*keys).distinct(), list(keys), "left_anti")
    return current.select(*keys, "branch", "sha").unionByName(rest.select(*keys, "branch", "sha"))


def changed_sets(moved: DataFrame, changed: DataFrame, *keys: str) -> DataFrame:
    """``moved`` heads with ``files``, the paths that changed since the old sha; null where there is no old sha, so that
    everything counts as changed. ``changed`` has a row per path; the sets are those of a commit, not of a repository."""
    sets = changed.groupBy(*keys, "branch").agg(F.sort_array(F.collect_set("path")).alias("_files"))
    joined = moved.join(sets, [*keys, "branch"], "left")
    known = F.coalesce("_files", F.array().cast("array<string>"))
    return joined.withColumn("files", F.when(F.col("old_sha").isNotNull(), known)).drop("_files")


def jobs_of(documents: DataFrame, changed: DataFrame, kind: str, key: str = "id", paths: str = "file_paths") -> DataFrame:
    """(kind, key): a job for each document that a change makes stale, once; the table is the queue."""
    return stale(documents, changed, key, paths).select(F.lit(kind).alias("kind"), F.col(key).alias("key")).distinct()


def run_each(keys: list[str], job: Callable[[str], int]) -> list[tuple[str, str, int]]:
    """(key, status, done) of ``job`` for each key in turn: one that fails is noted, and the others go on."""
    out = []
    for key in keys:
        try:
            out.append((key, "done", job(key)))
        except Exception as e:  # whatever a branch does to its job, the next one is another branch
            out.append((key, f"failed: {type(e).__name__}", 0))
    return out
