"""Cutting the lineage of iterative plans in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bits of the estimated size of a table from which on it tells nothing.
SIZE_BITS = 60


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name next to the checkpoints, for tables that a plan writes and reads again."""
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` in a few partitions for each core, for work that costs far more than reading its input."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *key)


def by_shuffle(rows: DataFrame) -> DataFrame:
    """``rows``, whose joins are by shuffle. The size of texts that a plan makes is estimated from the columns they are made
    of; by that number a table of texts would go to the driver to be broadcast."""
    return rows.hint("shuffle_merge")


def checkpointed(df: DataFrame, sized: bool = True) -> DataFrame:
    """``df`` written to the session's checkpoint folder. Without one, a session on one machine gets a temporary folder; on
    a cluster that would lose data and is an error. With ``sized`` false its estimated size is not kept, so that joins with
    what is taken from it go by what they shuffle."""
    shared_folder(df.sparkSession)
    return _with_plain_size(df.checkpoint(eager=True), sized)


def _with_plain_size(df: DataFrame, sized: bool = True) -> DataFrame:
    """``df``, which is materialised, with the default in place of an estimated size beyond all tables.

    A checkpoint keeps the estimate of the plan that made it, and joins multiply the estimates of their sides. In a loop
    the number grows until planning does little else than multiply it."""
    planned = df._jdf.queryExecution()
    if sized and int(planned.optimizedPlan().stats().sizeInBytes()).bit_length() <= SIZE_BITS:
        return df
    rows = df.sparkSession._jsparkSession.internalCreateDataFrame(planned.toRdd(), df._jdf.schema(), False)
    return DataFrame(rows, df.sparkSession)


def shared_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tessera-"))


#: Bytes of rows that go to a Python worker at once, so that ten thousand large rows do not.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at ``BATCH_BYTES`` as well as at their number of rows, unless the session has a lower bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key) or "").lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
