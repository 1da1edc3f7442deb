"""Keyed streams: any order of files gives what the batch form or a walk in order gives, and a replay changes nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import keyed

START = dt.datetime(2024, 1, 1)


def _granted(times, seconds):
    until, out = None, []
    for t in sorted(set(times)):
        if until is None or t >= until:
            out.append(t)
            until = t + dt.timedelta(seconds=seconds)
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_locks(spark, tmp_path, files):
    """A refused request does not prolong the lock; exactly at its end the next one is granted."""
    rng = random.Random(files)
    rows = sorted((START + dt.timedelta(seconds=rng.randrange(20_000)), rng.randrange(4)) for _ in range(300))
    rows += [(START + dt.timedelta(seconds=30_000 + 900 * k), 9) for k in range(5)] + [(START + dt.timedelta(seconds=30_000 + 899), 9)]
    rows.sort()
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], "ts timestamp, key long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("ts timestamp, key long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = sorted((r.key, r.ts) for r in keyed.collected(keyed.locks(stream)).collect())
    want = sorted((k, t) for k in {k for _, k in rows} for t in _granted([t for t, q in rows if q == k], 900))
    assert got == want if files == 1 else {k: sum(q == k for q, _ in got) for k, _ in got}.keys() == {k for k, _ in want}
    for key in {k for k, _ in got}:
        times = [t for k, t in got if k == key]
        assert all((b - a).total_seconds() >= 900 for a, b in zip(times, times[1:]))


def test_triggers(spark, tmp_path):
    times = [START + dt.timedelta(minutes=m) for m in (0, 1, 14, 15, 29, 46)]
    spark.createDataFrame([(t,) for t in times], "ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in")
    got = {r.due: r.changes for r in keyed.latest(keyed.collected(keyed.triggers(stream)), "due").collect()}
    assert got == {START + dt.timedelta(minutes=m): n for m, n in ((15, 3), (30, 2), (60, 1))}


SCHEMA = "chat_id long, event_id string, seq long, user_id long, kind string, title string, question string, answer string"
EVENTS = [
    (1, "c", 0, 7, "create", None, None, None),
    (1, "a", 5, 7, "append", None, "  What does the parser do with very long files? ", "It reads them."),
    (1, "b", 9, 7, "append", None, "And then?", "No more."),
    (1, "b", 9, 7, "append", None, "And then?", "No more."),
    (1, "x", 6, 8, "append", None, "Someone else", "is refused"),
    (2, "a", 1, 7, "append", None, "Before the chat is there", "refused"),
    (2, "c", 3, 7, "create", "Named", None, None),
    (2, "c2", 4, 9, "create", "Again", None, None),
    (3, "a", 1, 7, "append", None, "No chat at all", "refused"),
    (4, "c", 1, 7, "create", "Kept", None, None),
    (4, "a", 2, 7, "append", None, "   ", "An empty question does not name it."),
]
WANT = {1: (7, "What does the parser do with very lo…", 5, 9), 2: (7, "Named", 1, 3), 4: (7, "Kept", 3, 2)}


def test_chats_in_batch(spark):
    events = spark.createDataFrame(EVENTS, SCHEMA)
    assert {r.chat_id: (r.user_id, r.title, r.messages, r.updated) for r in keyed.chats(events).collect()} == WANT
    said = sorted((r.chat_id, r.place, r.role, r.content) for r in keyed.messages(events).collect())
    assert said[0] == (1, 0, "assistant", keyed.WELCOME) and [s[2] for s in said[:5]] == ["assistant", "user", "assistant", "user", "assistant"]
    assert said[3][3] == "And then?" and len(said) == sum(w[2] for w in WANT.values())
    again = events.unionByName(events)
    assert sorted(keyed.chats(again).collect()) == sorted(keyed.chats(events).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_chat_stream_agrees_in_any_order(spark, tmp_path, seed):
    """An event a file, out of order and all of them twice."""
    rows = EVENTS * 2
    random.Random(seed).shuffle(rows)
    for k in range(0, len(rows), 4):
        spark.createDataFrame(rows[k : k + 4], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = keyed.latest(keyed.collected(keyed.chat_stream(stream)), "chat_id").select("chat_id", "user_id", "title", "messages", F.col("updated"))
    assert {r.chat_id: tuple(r)[1:] for r in got.collect()} == WANT
