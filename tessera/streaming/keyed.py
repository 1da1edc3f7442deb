"""Keyed state over streams: locks that expire, aligned triggers, and the fold of a chat's event log.

Each has a batch form or a rule that says what its result is whatever the order in which files arrive. Streams here handle what
there is and stop; ``collected`` gives what they have put out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import chat_title
from tessera.operators.lineage import scratch

#: Seconds that a build holds its lock, minutes between triggers, and how a chat begins.
LOCK_SECONDS = 900
TRIGGER = "15 minutes"
NEW_TITLE = "New chat"
WELCOME = "Hi! I'm your AI assistant. How can I help you with onboarding today?"


def collected(stream: DataFrame, mode: str = "update", name: str = "stream") -> DataFrame:
    """What ``stream`` puts out over all there is, with ``batch``; a batch that is done again replaces its own rows."""
    spark: SparkSession = stream.sparkSession
    out = scratch(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema.add("batch", IntegerType())
    return spark.read.schema(schema).parquet(f"{out}/rows") if _exists(spark, f"{out}/rows") else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def locks(requests: DataFrame, key: str = "key", ts: str = "ts", seconds: int = LOCK_SECONDS, late: str = "1 hour") -> DataFrame:
    """(key, ts) of the requests of a stream that get the lock: the first of a key, and each that comes ``seconds`` or more after
    the last that got it. A lock is set only if there is none, and a refused request does not prolong it.

    The state of a key is one time; a timer of event time drops it once the lock has expired. Within a batch requests are
    taken in order of time; one that comes in a later batch and is older than the lock's end is refused."""
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("key", "ts", F.unix_micros("ts").alias("at"))

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else -(2**62)
        # different times of the key in this batch, in order
        times = np.unique(np.concatenate([p["at"].to_numpy(dtype=np.int64) for p in parts]))
        granted, i = [], int(np.searchsorted(times, until))
        while i < len(times):
            granted.append(times[i])
            until = int(times[i]) + seconds * 1_000_000
            i = int(np.searchsorted(times, until))
        state.update((until,))
        state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if granted:
            yield pd.DataFrame({"key": [k[0]] * len(granted), "at": granted})

    granted = rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, at long", "until long", "update", GroupStateTimeout.EventTimeTimeout)
    return granted.select("key", F.timestamp_micros("at").alias("ts"))


def triggers(changes: DataFrame, ts: str = "ts", every: str = TRIGGER, late: str = "1 hour") -> DataFrame:
    """(due, changes) of a stream: each change is due at the next full quarter of an hour, one exactly on it a quarter later."""
    due = F.window("ts", every)
    return changes.select(F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late).groupBy(due.alias("w")).agg(F.count(F.lit(1)).alias("changes")).select(F.col("w.end").alias("due"), "changes")


def _created(events: DataFrame) -> DataFrame:
    return events.where("kind = 'create'").groupBy("chat_id").agg(F.min(F.struct("seq", "user_id", F.coalesce("title", F.lit(NEW_TITLE)).alias("title"))).alias("c")).select("chat_id", F.col("c.seq").alias("created"), F.col("c.user_id").alias("owner"), F.col("c.title").alias("title"))


def accepted(events: DataFrame) -> DataFrame:
    """(chat_id, owner, title, created, turn, seq, question, answer): the appends that count, numbered within their chat.

    ``events`` has chat_id, event_id, seq, user_id, kind (create or append), title, question and answer. An event that is
    there again counts once. An append counts if its chat was created before it by the same user; other events are as
    the requests that are answered with an error. The first creation of a chat holds."""
    fields = [c for c in events.columns if c not in ("chat_id", "event_id")]
    once = events.groupBy("chat_id", "event_id").agg(F.min(F.struct("seq", *[c for c in fields if c != "seq"])).alias("e")).select("chat_id", "event_id", "e.*")
    turn = F.row_number().over(Window.partitionBy("chat_id").orderBy("seq", "event_id"))
    mine = once.where("kind = 'append'").drop("title").join(_created(once), "chat_id").where("user_id = owner and seq > created")
    return mine.select("chat_id", "owner", "title", "created", turn.alias("turn"), "seq", "question", "answer")


def chats(events: DataFrame) -> DataFrame:
    """(chat_id, user_id, title, messages, updated): each chat as the log leaves it. The first question names the chat."""
    once = events.groupBy("chat_id", "event_id").agg(F.min(F.struct("seq", "user_id", "kind", "title")).alias("e")).select("chat_id", "e.*")
    by = accepted(events).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.min_by("question", "turn").alias("first"))
    named = F.coalesce(F.nullif(chat_title(F.col("first")), F.lit("")), F.col("title"))
    return _created(once).join(by, "chat_id", "left").select("chat_id", F.col("owner").alias("user_id"), named.alias("title"), (1 + 2 * F.coalesce("n", F.lit(0))).alias("messages"), F.coalesce("last", "created").alias("updated"))


def messages(events: DataFrame) -> DataFrame:
    """(chat_id, place, role, content, seq): the welcome, then a question and its answer for each append that counts."""
    pair = F.array(F.struct((2 * F.col("turn") - 1).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((2 * F.col("turn")).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    said = accepted(events).select("chat_id", "seq", F.explode(pair).alias("m")).select("chat_id", "m.*", "seq")
    first = _created(events).select("chat_id", F.lit(0).alias("place"), F.lit("assistant").alias("role"), F.lit(WELCOME).alias("content"), F.col("created").alias("seq"))
    return first.unionByName(said)


def chat_stream(events: DataFrame) -> DataFrame:
    """``chats`` over a stream of events: a chat anew whenever one of its events arrives, late and repeated ones included.

    The state of a chat is a short line for each of its events (no contents), so the result is that of the whole log
    in whatever order it came."""
    named = events.select("chat_id", "event_id", "seq", "user_id", "kind", F.when(F.col("kind") == "create", F.col("title")).otherwise(F.nullif(chat_title(F.col("question")), F.lit(""))).alias("title"))
    ids, users = (events.schema[c].dataType.simpleString() for c in ("event_id", "user_id"))

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        for p in parts:
            for e, *line in zip(p["event_id"].tolist(), p["seq"].tolist(), p["user_id"].tolist(), p["kind"].tolist(), [None if pd.isna(t) else t for t in p["title"]]):
                if e not in seen or tuple(line[:1]) < seen[e][:1]:
                    seen[e] = tuple(line)
        state.update((list(seen), *[list(c) for c in zip(*seen.values())]))
        created = min((line[0], line[1], line[3] or NEW_TITLE) for line in seen.values() if line[2] == "create") if any(line[2] == "create" for line in seen.values()) else None
        if created:
            mine = sorted((line[0], e, line[3]) for e, line in seen.items() if line[2] == "append" and line[1] == created[1] and line[0] > created[0])
            title = (mine[0][2] or created[2]) if mine else created[2]
            yield pd.DataFrame({"chat_id": [k[0]], "user_id": [created[1]], "title": [title], "messages": [1 + 2 * len(mine)], "updated": [mine[-1][0] if mine else created[0]]})

    out = f"chat_id {events.schema['chat_id'].dataType.simpleString()}, user_id {users}, title string, messages int, updated long"
    kept = f"event_id array<{ids}>, seq array<long>, user_id array<{users}>, kind array<string>, title array<string>"
    return named.groupBy("chat_id").applyInPandasWithState(run, out, kept, "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of what a stream put out in update mode, the last of each key."""
    fields = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*key, "r.*")
