"""The periodic sync as a stream of head changes: compare, invalidate, advance, once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.store import VersionedTable
from tessera.operators.sync import advance, changed_heads


def head_updates(spark: SparkSession, folder: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def sync_stream(updates: DataFrame, state: VersionedTable, on_change: Callable[[DataFrame, int], None], checkpoint: str, keys: tuple[str, ...] = ("repo_id",), every: str | None = None) -> StreamingQuery:
    """Feed updates (keys, branch, sha, ordinal) to the stored heads.

    Each batch calls ``on_change`` with the moved and new heads and then advances the state. Without ``every`` the
    query handles what there is and stops. Replaying a batch finds no change, so a retry is harmless.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        last = Window.partitionBy(*keys, "branch").orderBy(F.desc("ordinal"))
        current = batch.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*keys, "branch", "sha")
        stored = state.read()
        stored = stored if stored is not None else current.limit(0)
        on_change(changed_heads(stored, current, *keys), batch_id)
        # heads of branches without news stay
        merged = current.unionByName(stored.join(current.select(*keys, "branch"), [*keys, "branch"], "left_anti").select(*keys, "branch", "sha"))
        state.write(advance(stored, merged, *keys))

    writer = updates.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def once_per_window(jobs: DataFrame, key: str, ts: str = "ts", window: str = "15 minutes") -> DataFrame:
    """A job is let through once per key within the window, like a lock that expires."""
    stamped = jobs.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])
