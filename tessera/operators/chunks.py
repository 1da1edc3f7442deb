"""Retrieval chunks from symbols: by function, by call flow, or both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lines_between
from tessera.operators import graph
from tessera.operators.graph import last_wins
from tessera.operators.lineage import by_shuffle, checkpointed

STRATEGIES = ("function", "flow", "hybrid")


def function_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, type, content, file_path, name, ordinal): a chunk for each symbol, the whole file where it has none.

    Ids are `path:name`, `path:Class.method`, `path:route:method:i` and `path:default_export:i`, `path:file`.
    """
    f = by_shuffle(files.select("path", "content"))
    joined = symbols.join(f, "path")
    sid = (
        F.when(F.col("kind") == "method", F.concat_ws(":", "path", F.concat_ws(".", "parent", "name")))
        .when(F.col("kind") == "route", F.concat_ws(":", "path", F.lit("route"), "name", F.col("ordinal").cast("string")))
        .when(F.col("kind") == "default_export", F.concat_ws(":", "path", F.lit("default_export"), F.col("ordinal").cast("string")))
        .otherwise(F.concat_ws(":", "path", "name"))
    )
    named = joined.select(sid.alias("id"), F.col("kind").alias("type"), lines_between(F.col("content"), F.col("start_line"), F.col("end_line")).alias("content"), F.col("path").alias("file_path"), "name", "ordinal")
    bare = f.where(F.trim("content") != "").join(symbols.select("path").distinct(), "path", "left_anti")
    whole = bare.select(F.concat_ws(":", "path", F.lit("file")).alias("id"), F.lit("file").alias("type"), "content", F.col("path").alias("file_path"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("ordinal"))
    return named.unionByName(whole)


def flow_chunks(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, type, content, members): functions with all they reach, in breadth-first order, as one chunk each.

    ``functions`` has id, path, name, content and place, an order in which they are gone through; ``calls`` (source_id,
    name) reach every function of the name. A function that an earlier one reaches begins no chunk; one that reaches
    no other is a function chunk. Callees of one function come in the order of their places.
    """
    known = functions.select("id", "name", "place")
    begins = checkpointed(graph.first_callers(known, calls).where("place = first").select(F.col("id").alias("start")))
    reach = graph.discovered(begins, known, calls).withColumnRenamed("node", "id")
    part = F.concat(F.lit("// "), "path", F.lit(":"), "name", F.lit("\n"), "content").alias("part")
    parts = reach.join(functions, "id").select("start", "depth", "number", "id", part, "content")
    chains = parts.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("depth", "number", "id", "part", "content"))).alias("c"))
    alone = F.size("c") == 1
    return chains.select(
        F.when(alone, F.col("start")).otherwise(F.concat(F.lit("flow:"), "start")).alias("id"),
        F.when(alone, "function").otherwise("flow").alias("type"),
        F.when(alone, F.col("c")[0]["content"]).otherwise(F.array_join(F.transform("c", lambda x: x["part"]), "\n\n")).alias("content"),
        F.transform("c", lambda x: x["id"]).alias("members"),
    )


def hybrid(function: DataFrame, flow: DataFrame) -> DataFrame:
    """Flow chunks replace their members; of equal ids the later one wins. Columns id, type, content, ordinal."""
    gone = flow.where("type = 'flow'").select(F.explode("members").alias("id")).distinct()
    kept = function.select("id", "type", "content", F.col("ordinal").cast("long").alias("ordinal")).join(gone, "id", "left_anti")
    added = flow.where("type = 'flow'").select("id", "type", "content", F.lit(1 << 40).alias("ordinal"))
    return last_wins(kept.unionByName(added), "id", "ordinal")


def create_chunks(strategy: str, files: DataFrame, symbols: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "function":
        return function_chunks(files, symbols)
    flow = flow_chunks(functions, calls)
    return flow if strategy == "flow" else hybrid(function_chunks(files, symbols), flow)
