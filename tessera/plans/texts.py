"""Texts put together from rows: titles, summaries, listings, query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import prompts, resolve
from tessera.registry import query
from tessera.session import table


def _s(c: str):
    return F.col(c).cast("string")


@query(
    "document_titles",
    "F14 K27",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id WHEN doc_id % 3 = 1 AND trim(left(trim(string_split_regex(trim(text), '[.!?]\\s+')[1]), 100)) <> '' THEN left(trim(string_split_regex(trim(text), '[.!?]\\s+')[1]), 100)
    ELSE CASE WHEN length(trim(left(text, 60))) < length(text) THEN trim(left(text, 60)) || '...' ELSE trim(left(text, 60)) END END AS title FROM documents""",
)
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    title = F.when(k == 0, F.concat(F.lit("T"), _s("doc_id"))).when(k == 1, F.repeat(F.lit("x"), F.lit(101)))
    described = F.when(k == 1, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.document_title(title, described, F.col("text")).alias("title"))


@query("diagram_summaries", "F13", "SELECT o_custkey, 'States: ' || string_agg(o_orderstatus, ', ' ORDER BY o_orderkey) || '. Transitions: ' || count(*) || '.' AS summary FROM orders GROUP BY 1")
def diagram_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    states = F.transform("o", lambda x: F.struct(F.lit("").alias("label"), x["o_orderstatus"].alias("id")))
    data = rows.select("o_custkey", F.struct(states.alias("states"), F.col("o").alias("transitions")).alias("d"))
    return data.select("o_custkey", prompts.diagram_summary("state", F.col("d")).alias("summary"))


@query(
    "chunk_listing",
    "F26",
    """SELECT p_partkey, '--- Chunk ' || p_partkey || ' | repo: c-d | file: f' || p_size || '.py' || CASE WHEN p_partkey % 2 = 0 THEN ' | type: function' ELSE '' END || ' | class: ' || p_brand || ' | lines: ' || p_size || '-? ---' || chr(10) || p_name AS listed,
    'File: f' || p_size || '.py' || chr(10) || 'Class: ' || p_brand || chr(10) || 'Content:' || chr(10) || left(p_name, 5) AS labelled FROM part""",
)
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, path = F.lit(None).cast("string"), F.concat(F.lit("f"), _s("p_size"), F.lit(".py"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("")
    listed = prompts.listed_chunk(F.col("p_partkey"), F.lit("a_b_c_d_main"), path, kind, F.col("p_brand"), F.lit(""), F.col("p_size"), none, F.col("p_name"))
    labelled = prompts.labelled_chunk(path, F.col("p_brand"), none, F.lit("  "), F.col("p_name"), 5)
    return table(spark, sf_dir, "part").select("p_partkey", listed.alias("listed"), labelled.alias("labelled"))


@query("task_queries", "F33", "SELECT o_orderkey, 'Order ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' ' || o_orderpriority ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' (bug)' ELSE '' END AS q FROM orders")
def task_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    q = prompts.task_query(F.concat(F.lit("Order "), "o_orderstatus"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(""), F.when(k % 3 == 0, "bug"))
    return table(spark, sf_dir, "orders").select("o_orderkey", q.alias("q"))


@query("path_queries", "F32 T11", "SELECT r_regionkey, r_name || ' ' || string_agg(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' even' ELSE '' END, ' ' ORDER BY -n_nationkey) AS q FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def path_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    module = F.struct((-F.col("n_nationkey")).alias("order"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("").alias("summary"))
    rows = joined.groupBy("r_regionkey", "r_name").agg(F.collect_list(module).alias("modules"))
    return rows.select("r_regionkey", prompts.path_query(F.col("r_name"), F.lit(None).cast("string"), F.col("modules")).alias("q"))


@query("contributor_lines", "F26 M27", "SELECT s_suppkey, '- ' || s_name || ' (@s' || s_suppkey || ') — ' || s_nationkey || ' commits to r' AS line FROM supplier")
def contributor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = prompts.contributor_line(F.col("s_name"), F.concat(F.lit("s"), _s("s_suppkey")), _s("s_nationkey"), F.lit("r"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))


@query(
    "sample_signatures",
    "F16 F18 F19",
    """SELECT p_partkey, 'd' || p_size || '.' || p_brand || '(user_id=''example_id'', n=3, x=None)' AS signature, 'does things' AS said FROM part""",
)
def sample_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/d"), _s("p_size"), F.lit("/m.py"))
    parameter = lambda name, default: F.struct(F.lit(name).alias("name"), F.lit(default).cast("string").alias("default_value"))
    given = F.array(parameter("user_id", None), parameter("n", "3"), parameter("x", ""))
    said = prompts.without_name(F.concat("p_brand", F.lit(" is does things")), F.upper("p_brand"))
    said = F.regexp_replace(said, "^is ", "")
    return table(spark, sf_dir, "part").select("p_partkey", prompts.sample_signature(path, F.col("p_brand"), given).alias("signature"), said.alias("said"))


@query("served_nodes", "T12", "SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE text END AS description, CASE WHEN length(text) > 1500 THEN left(text, 1500) || chr(10) || '// ... (truncated)' ELSE text END AS code_sample FROM documents")
def served_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.capped_node(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"), F.col("text").alias("code_sample")))


_SITES = "s AS (SELECT 'p' || l_suppkey AS path, CASE WHEN l_linenumber > 2 THEN 'c' || l_partkey % 9 END AS context, 'f' || l_orderkey % 13 AS function_name FROM lineitem)"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), _s("l_suppkey")).alias("path"), F.when(F.col("l_linenumber") > 2, number("c", "l_partkey", 9)).alias("context"), number("f", "l_orderkey", 13).alias("function_name"))


@query("calls_made", "J6", f"WITH {_SITES} SELECT path, context, string_agg(function_name, ',' ORDER BY function_name) AS calls FROM s WHERE context IS NOT NULL GROUP BY 1, 2")
def calls_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.calls_made(_sites(spark, sf_dir)).withColumn("calls", F.array_join("calls", ","))


@query("called_by", "J7", f"WITH {_SITES} SELECT function_name, path || ':' || coalesce(context, 'unknown') AS caller, count(*) AS n FROM s GROUP BY 1, 2")
def called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.called_by(_sites(spark, sf_dir)).groupBy("function_name", "caller").agg(F.count(F.lit(1)).alias("n"))
