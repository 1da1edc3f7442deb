"""Queries that run as streams over the given tables: locks, triggers and chat logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import scratch
from tessera.registry import query
from tessera.session import table
from tessera.streaming import keyed


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern as its path lets it be a folder or a single file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query(
    "build_locks",
    "Q9",
    """WITH RECURSIVE e AS (SELECT user_id AS k, ts FROM events), g AS (SELECT k, min(ts) AS ts FROM e GROUP BY k UNION ALL SELECT g.k, (SELECT min(e.ts) FROM e WHERE e.k = g.k AND e.ts >= g.ts + INTERVAL 900 SECOND) FROM g WHERE g.ts IS NOT NULL)
    SELECT k AS repo_id, ts AS granted_at FROM g WHERE ts IS NOT NULL""",
)
def build_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for a build of its user's graph; while one is under way, others are refused."""
    granted = keyed.collected(keyed.locks(_stream(spark, sf_dir, "events"), "user_id"), name="locks")
    return granted.select(F.col("key").alias("repo_id"), F.col("ts").cast("timestamp_ntz").alias("granted_at"))


@query("sync_triggers", "Q1", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS due, count(*) AS changes FROM events GROUP BY 1")
def sync_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run at minutes 0, 15, 30 and 45 finds."""
    found = keyed.latest(keyed.collected(keyed.triggers(_stream(spark, sf_dir, "events")), name="triggers"), "due")
    return found.select(F.col("due").cast("timestamp_ntz").alias("due"), "changes")


#: Each conversation is created by a user and gets its pairs of turns; every eleventh has pairs of someone else, every
#: fifth is never created, and every third turn is told twice.
_CHATS = """
c AS (SELECT conv_id AS chat_id, min(turn) - 1 AS seq, conv_id % 7 AS user_id FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id),
a AS (SELECT u.conv_id AS chat_id, u.turn AS seq, CASE WHEN u.conv_id % 11 = 0 AND u.turn % 4 = 0 THEN 99 ELSE u.conv_id % 7 END AS user_id, u.text AS question, v.text AS answer
  FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant'),
k AS (SELECT a.*, row_number() OVER (PARTITION BY chat_id ORDER BY a.seq) AS n FROM a JOIN c USING (chat_id, user_id) WHERE a.seq > c.seq)
"""


def _chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    created = t.where("conv_id % 5 <> 0").groupBy(F.col("conv_id").alias("chat_id")).agg((F.min("turn") - 1).alias("seq"))
    created = created.select("chat_id", F.lit("new").alias("event_id"), "seq", (F.col("chat_id") % 7).alias("user_id"), F.lit("create").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"))
    answers = t.where("role = 'assistant'").select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("answer"))
    asked = t.where("role = 'user'").join(answers, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    user = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") % 4 == 0), 99).otherwise(F.col("conv_id") % 7)
    twice = F.when(F.col("turn") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    pairs = asked.withColumn("_again", F.explode(twice)).select(F.col("conv_id").alias("chat_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("event_id"), F.col("turn").alias("seq"), user.cast("long").alias("user_id"), F.lit("append").alias("kind"), F.lit(None).cast("string").alias("title"), F.col("text").alias("question"), "answer")
    return created.unionByName(pairs)


@query(
    "chat_log",
    "D7 A21 F30",
    f"""WITH {_CHATS}, s AS (SELECT chat_id, count(*) AS n, max(seq) AS last, min_by(trim(question), n) AS t FROM k GROUP BY 1)
    SELECT chat_id, user_id, coalesce(nullif(CASE WHEN length(t) > 36 THEN left(t, 36) || '…' ELSE t END, ''), 'New chat') AS title, (1 + 2 * coalesce(s.n, 0))::INT AS messages, coalesce(last, c.seq) AS updated FROM c LEFT JOIN s USING (chat_id)""",
)
def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats as a stream leaves them that gets the events in three parts, in no order, some twice. A part has a file for each core."""
    events = _chat_events(spark, sf_dir)
    at = scratch(spark, "chat-events")
    files = spark.sparkContext.defaultParallelism
    events.repartition(3 * files, "chat_id", "event_id").write.parquet(at)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(at)
    return keyed.latest(keyed.collected(keyed.chat_stream(stream), name="chats"), "chat_id")


@query(
    "chat_messages",
    "D7 M25",
    f"""WITH {_CHATS} SELECT chat_id, 0::INT AS place, 'assistant' AS role, $${keyed.WELCOME}$$ AS content, seq FROM c UNION ALL SELECT chat_id, (2 * n - 1)::INT, 'user', question, seq FROM k UNION ALL SELECT chat_id, (2 * n)::INT, 'assistant', answer, seq FROM k""",
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.messages(_chat_events(spark, sf_dir))
