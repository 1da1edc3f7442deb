"""Shared helpers of the training-data operators: table access, lineage cuts, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed

#: Rows of a few numbers each up to which a counted side of a join is broadcast: some tens of MB.
LIGHT_ROWS = 1_000_000


#: Rows of a few numbers each that are worth a task in a loop.
TASK_ROWS = 20_000

#: Bytes of texts that go to a Python worker at once, so that ten thousand long texts do not.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at ``BATCH_BYTES`` as well as at their number of rows, unless the session has a lower bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key) or "").lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    A session on one machine without one gets a temporary folder; on a cluster that would lose data and is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under a new name in the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return checkpointed(df)


def gathered(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df``, which has about ``rows`` rows, in no more tasks than ``each`` rows apiece fill; never in more than it has.

    Every task of a shuffle leaves files, whatever its rows: loops over small tables otherwise cost the tasks, not the rows."""
    return df.coalesce(max(1, -(-rows // each)))


def swept(spark: SparkSession) -> None:
    """Have files of shuffles and checkpoints that nothing refers to any more removed; the driver collects its garbage, and
    with it those, only when its heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released() -> None:
    """Give memory that is free in this process back to the system: a driver may go on for long after it has trained a model."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def light(df: DataFrame, most: int = LIGHT_ROWS) -> DataFrame:
    """``df``, materialised and counted, marked for broadcast if it has at most ``most`` rows.

    Beyond that the join shuffles both sides. It spares shuffling whole texts to find a few of them.
    """
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df
