"""Keyed stores, sync and chats: events before and after a cut-off are the old and the new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import store, sync
from tessera.registry import query
from tessera.session import table


def _heads(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """(repo_id, branch, sha): the last event of each user and type, of the first half or of all even users' events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), F.col("event_type").alias("branch"), "event_id")
    half = e.where("event_id % 4 != 0") if new else e.where("event_id % 3 != 0 and event_id % 4 = 1")
    return half.groupBy("repo_id", "branch").agg(F.max("event_id").cast("string").alias("sha"))


_HEADS = """
s AS (SELECT user_id AS repo_id, event_type AS branch, max(event_id)::VARCHAR AS sha FROM events WHERE event_id % 3 <> 0 AND event_id % 4 = 1 GROUP BY 1, 2),
c AS (SELECT user_id AS repo_id, event_type AS branch, max(event_id)::VARCHAR AS sha FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2)
"""


@query("branch_cdc", "Q2 M21", f"WITH {_HEADS} SELECT c.repo_id, c.branch, c.sha, s.sha AS old_sha FROM c LEFT JOIN s USING (repo_id, branch) WHERE c.sha IS DISTINCT FROM s.sha")
def branch_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_map = lambda d: d.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("branch", "sha"))).alias("heads"))
    old, new = (sync.heads(as_map(_heads(spark, sf_dir, n)), "heads", "repo_id") for n in (False, True))
    return sync.changed_heads(old, new, "repo_id").select("repo_id", "branch", "sha", "old_sha")


@query("state_advance", "Q7 D3 K25", f"WITH {_HEADS}, n AS (SELECT * FROM c WHERE repo_id % 2 = 0) SELECT * FROM n UNION ALL SELECT * FROM s WHERE repo_id NOT IN (SELECT repo_id FROM n)")
def state_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.advance(_heads(spark, sf_dir, False), _heads(spark, sf_dir, True).where("repo_id % 2 = 0"), "repo_id")


@query(
    "doc_invalidation",
    "Q5 U5 D5",
    "SELECT o_orderkey AS id, bool_or(l_partkey % 97 = 5) AS needs_sync FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def doc_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    docs = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("file_paths"))
    changed = table(spark, sf_dir, "part").where("p_partkey % 97 = 5").select(F.col("p_partkey").cast("string").alias("path"))
    return store.set_flag(docs.withColumn("needs_sync", F.lit(False)), sync.stale(docs, changed).select("id"), "id", "needs_sync").select("id", "needs_sync")


@query(
    "changed_files",
    "S3",
    "SELECT coalesce(a.l_orderkey, b.l_orderkey) || '/' || coalesce(a.l_linenumber, b.l_linenumber) AS path FROM (SELECT l_orderkey, l_linenumber, string_agg(l_partkey, ',' ORDER BY l_partkey) AS c FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2) a FULL JOIN (SELECT l_orderkey, l_linenumber, string_agg(l_partkey + CASE WHEN l_orderkey % 10 = 1 THEN 1 ELSE 0 END, ',' ORDER BY l_partkey) AS c FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.c IS DISTINCT FROM b.c",
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")

    def snapshot(rows: DataFrame, shift) -> DataFrame:
        path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        listed = F.sort_array(F.collect_list(F.col("l_partkey") + shift))
        return rows.groupBy(path.alias("path")).agg(F.array_join(listed.cast("array<string>"), ",").alias("content"))

    one = F.when(F.col("l_orderkey") % 10 == 1, 1).otherwise(0)
    return sync.changed_files(snapshot(li.where("l_orderkey % 3 != 0"), F.lit(0)), snapshot(li.where("l_orderkey % 5 != 0"), one))


def _records(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == rest)
    last = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("event_id")))
    e = e.withColumn("_r", last).where("_r = 1")
    note = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, None).otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string")))
    return e.select("user_id", "event_type", note.alias("note"), "event_id", F.col("event_id").alias("created"))


_RECORDS = """
a AS (SELECT *, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'n' || event_id END AS note FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id DESC) = 1),
o AS (SELECT * FROM a WHERE event_id % 2 = 0 AND user_id % 3 <> 0), n AS (SELECT * FROM a WHERE event_id % 2 = 1 AND user_id % 3 <> 1),
m AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, coalesce(nullif(n.note, ''), o.note) AS note, coalesce(n.event_id, o.event_id) AS event_id, coalesce(o.event_id, n.event_id) AS created, CASE WHEN o.user_id IS NULL THEN 'created' WHEN n.user_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS action FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type)
"""


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _records(spark, sf_dir, 0).where("user_id % 3 != 0"), _records(spark, sf_dir, 1).where("user_id % 3 != 1")
    return store.upsert(old, new, ["user_id", "event_type"], keep_old=["note"], replace=["event_id"], created="created")


@query("upsert_keep_old", "D1 D2", f"WITH {_RECORDS} SELECT * FROM m")
def upsert_keep_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir)


@query("upsert_action", "D1 D2", f"WITH {_RECORDS} SELECT action, count(*) AS n FROM m GROUP BY 1")
def upsert_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "slug_dedup",
    "U6 F12",
    """WITH p AS (SELECT p_partkey, 'class-' || replace(lower(p_name), ' ', '-') AS slug FROM part), e AS (SELECT DISTINCT slug FROM p WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT slug || '-' || (p_partkey % 5 + 2) FROM p WHERE p_partkey % 7 = 0),
    q AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - CASE WHEN slug IN (SELECT slug FROM e) THEN 0 ELSE 1 END AS k FROM p),
    f AS (SELECT s.slug, n, row_number() OVER (PARTITION BY s.slug ORDER BY n) AS k FROM (SELECT slug, unnest(range(2, count(*) + 10)) AS n FROM p GROUP BY 1) s WHERE s.slug || '-' || n NOT IN (SELECT slug FROM e))
    SELECT p_partkey, q.slug, CASE WHEN q.k = 0 THEN q.slug ELSE q.slug || '-' || n END AS "unique" FROM q LEFT JOIN f ON q.slug = f.slug AND q.k = f.k""",
)
def slug_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", text.slug("class", F.col("p_name")).alias("slug"))
    taken = p.where("p_partkey % 2 = 0").select("slug").unionByName(p.where("p_partkey % 7 = 0").select(F.concat("slug", F.lit("-"), (F.col("p_partkey") % 5 + 2).cast("string")).alias("slug")))
    return store.unique_slugs(p, taken, order="p_partkey")


@query(
    "token_resolution",
    "P17",
    """WITH u AS (SELECT c_custkey AS user_id, c_name AS token FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal > 0) SELECT o_orderkey AS repo_id, coalesce(a.token, b.token) AS token, CASE WHEN a.token IS NOT NULL THEN 'added_by' WHEN b.token IS NOT NULL THEN 'owner' END AS source
    FROM orders LEFT JOIN u a ON o_custkey = a.user_id LEFT JOIN (SELECT s_suppkey, token FROM supplier JOIN u ON s_suppkey * 3 = user_id) b ON s_suppkey = o_orderkey % 10""",
)
def token_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "active").otherwise("gone").alias("status"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("  ").alias("token"))
    orgs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("organization_id"), (F.col("s_suppkey") * 3).alias("owner_id"))
    repos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("repo_id"), F.col("o_custkey").alias("added_by"), (F.col("o_orderkey") % 10).alias("organization_id"))
    return store.active_token(repos, users, orgs)


@query("chat_list", "D7 A21 T8", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id")
def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))
    return chats.orderBy(F.desc("last_turn"), "conv_id")


@query("chat_projection", "D7 M25", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'bot' ELSE role END AS sender, text FROM conversations")
def chat_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chat_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "sender", "text")


@query(
    "chat_titles",
    "F30 D7",
    "WITH m AS (SELECT conv_id, min_by(trim(text), (turn, text)) AS t FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, CASE WHEN length(t) > 36 THEN left(t, 36) || '…' ELSE t END AS title FROM m",
)
def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", F.trim("text"))).alias("t"))
    return first.select("conv_id", text.chat_title(F.col("t")).alias("title"))
