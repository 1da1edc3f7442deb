"""Regeneration of stale documents as one commit over several stores, by an intent log.

A run first writes what it is about to store, text, paths and flags of every document, as one version of the log: from then
on the run counts. Text and metadata follow, each as a version of its own table, and at last a version of the log without
intents. Every step but the first is a merge by key of what the log says, so whoever finds intents in the log repeats
the steps and ends where an undisturbed run would have; a run that died before its intents were written has changed nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.store import VersionedTable

INTENT = "doc_id long, text string, file_paths array<string>, error string"


@dataclass
class Stores:
    """``texts`` (doc_id, text), ``metadata`` (doc_id, file_paths, needs_sync, is_updating, error) and the log of intents."""

    texts: VersionedTable
    metadata: VersionedTable
    log: VersionedTable


def _best(hits: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk"))
    return hits.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def context(hits: DataFrame, k: int = 20, others: int = 5) -> DataFrame:
    """(doc_id, context, file_paths): what a document is written from: the ``k`` best chunks of its own collection and the ``others``
    best of each other collection of its organisation, in this order, and the different paths of their files, blank ones left out.

    ``hits`` has (doc_id, collection, own, score, chunk, path); without a chunk of its own a document has none at all. Ties go
    by the chunk's name."""
    best = _best(hits.where("own"), k, "doc_id").unionByName(_best(hits.where("not own"), others, "doc_id", "collection"))
    order = F.sort_array(F.collect_list(F.struct((~F.col("own")).alias("o"), F.when(~F.col("own"), F.col("collection")).alias("c"), (-F.col("score")).alias("s"), "chunk")))
    paths = F.sort_array(F.collect_set(F.when(F.trim(F.coalesce("path", F.lit(""))) != "", F.trim("path"))))
    rows = best.groupBy("doc_id").agg(F.transform(order, lambda x: x["chunk"]).alias("context"), paths.alias("file_paths"), F.bool_or("own").alias("_own"))
    return rows.where("_own").drop("_own")


def intents(stale: DataFrame, found: DataFrame, generate: Callable[[Column, Column], Column]) -> DataFrame:
    """What is to be stored for each of ``stale`` (doc_id, prompt): the text made of prompt and context, or the error for
    which it stays as it is."""
    j = stale.join(found, "doc_id", "left")
    text = F.when(F.col("context").isNotNull(), generate(F.col("prompt"), F.col("context")))
    error = F.when(F.trim(F.coalesce("prompt", F.lit(""))) == "", "no stored prompt").when(F.col("context").isNull(), "no chunks").when(F.coalesce(text, F.lit("")) == "", "empty documentation")
    kept = lambda c: F.when(error.isNull(), c)
    return j.select(F.col("doc_id").cast("long").alias("doc_id"), kept(text).alias("text"), kept(F.col("file_paths")).alias("file_paths"), error.alias("error"))


def begin(stores: Stores, wanted: DataFrame) -> None:
    """Write ``wanted`` to the log. There must be none open: ``finish`` those first."""
    after = stores.log.version()
    if open_intents(stores) is not None:
        raise RuntimeError("intents are open; finish them first")
    stores.log.write(wanted, after=after)


def open_intents(stores: Stores) -> DataFrame | None:
    logged = stores.log.read()
    return None if logged is None or logged.isEmpty() else logged


def finish(stores: Stores) -> bool:
    """Bring texts, paths and flags to what the log says and close it; whether there was anything to do. Safe to repeat.

    A document that failed keeps its text, stays stale and is no longer being worked on."""
    wanted = open_intents(stores)
    if wanted is None:
        return False
    done = wanted.where("error is null")
    texts = stores.texts.read()
    kept = texts.join(wanted.where("error is null").select("doc_id"), "doc_id", "left_anti") if texts is not None else None
    new = done.select("doc_id", "text")
    stores.texts.write(new if kept is None else kept.select("doc_id", "text").unionByName(new))
    w = wanted.select("doc_id", F.col("file_paths").alias("_p"), F.col("error").alias("_e"), F.lit(True).alias("_hit"))
    hit, fine = F.coalesce("_hit", F.lit(False)), F.col("_e").isNull()
    rows = stores.metadata.read().join(w, "doc_id", "left")
    stores.metadata.write(
        rows.select(
            "doc_id",
            F.when(hit & fine, F.col("_p")).otherwise(F.col("file_paths")).alias("file_paths"),
            F.when(hit & fine, F.lit(False)).otherwise(F.col("needs_sync")).alias("needs_sync"),
            F.when(hit, F.lit(False)).otherwise(F.col("is_updating")).alias("is_updating"),
            F.when(hit, F.col("_e")).otherwise(F.col("error")).alias("error"),
        )
    )
    stores.log.write(wanted.limit(0))
    return True


def regenerate(stores: Stores, prompts: DataFrame, hits: DataFrame, generate: Callable[[Column, Column], Column]) -> None:
    """Finish what a run before has left, then make all stale documents anew. ``prompts`` has (doc_id, prompt)."""
    finish(stores)
    stale = stores.metadata.read().where("needs_sync").select("doc_id").join(prompts, "doc_id")
    begin(stores, intents(stale, context(hits), generate))
    finish(stores)
