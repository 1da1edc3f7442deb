"""Graph queries: pages give a path hierarchy, line items the edges between suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.registry import query
from tessera.session import table


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), graph.normal_path(path).alias("path"))


PATHS_SQL = """
p AS (SELECT page_id AS ordinal, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda s: s <> '') AS parts FROM pages),
x AS (SELECT ordinal, parts, unnest(range(1, len(parts) + 1)) AS k FROM p),
h AS (SELECT ordinal, k - 1 AS depth, array_to_string(parts[1:k], '/') AS prefix, CASE WHEN k > 1 THEN array_to_string(parts[1:k-1], '/') END AS parent, parts[k] AS name, CASE WHEN k = len(parts) THEN 'File' ELSE 'Folder' END AS label FROM x)
"""


@query(
    "path_hierarchy_nodes",
    "G1 U1 F5",
    f"WITH {PATHS_SQL} SELECT left(sha1(label || ':' || prefix), 16) AS id, label, prefix, any_value(name) AS name, any_value(depth)::BIGINT AS depth FROM h GROUP BY label, prefix",
)
def path_hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.hierarchy_nodes(graph.path_prefixes(_paths(spark, sf_dir)), "ordinal")
    return nodes.select("id", "label", "prefix", "name", F.col("depth").cast("long").alias("depth"))


@query(
    "path_hierarchy_edges_bag",
    "G1 F5 K9 K10",
    f"""WITH {PATHS_SQL}, e AS (SELECT left(sha1('Folder:' || parent), 16) AS source_id, left(sha1(label || ':' || prefix), 16) AS target_id FROM h WHERE parent IS NOT NULL)
    SELECT left(sha1('CONTAINS:' || source_id || ':' || target_id), 16) AS id, 'CONTAINS' AS type, source_id, target_id, count(*) AS n FROM e GROUP BY ALL""",
)
def path_hierarchy_edges_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.hierarchy_edges(graph.path_prefixes(_paths(spark, sf_dir)))
    return edges.groupBy("id", "type", "source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (negative ids) to parts; a line item is a call."""
    return table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey") - 1).alias("source_id"), F.col("l_partkey").alias("target_id"), "l_linestatus", "l_returnflag")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(1).alias("start_line"), (F.col("p_size") + 1).alias("end_line"), (F.col("p_partkey") % 25).alias("community"))
    return parts.unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.lit(10).alias("start_line"), F.lit(5).alias("end_line"), F.col("s_nationkey").cast("long").alias("community")))


_GRAPH_SQL = """
e AS (SELECT -l_suppkey - 1 AS s, l_partkey AS t FROM lineitem),
n AS (SELECT p_partkey AS id, p_size::BIGINT AS loc, p_partkey % 25 AS c FROM part UNION ALL SELECT -s_suppkey - 1, 0, s_nationkey FROM supplier),
m AS (SELECT s, t FROM e WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)),
i AS (SELECT t AS id, count(*) AS in_degree FROM m GROUP BY 1), o AS (SELECT s AS id, count(*) AS out_degree FROM m GROUP BY 1),
x AS (SELECT m.s, m.t FROM m JOIN n a ON m.s = a.id JOIN n b ON m.t = b.id WHERE a.c <> b.c),
k AS (SELECT id, count(*) AS crossings FROM (SELECT s AS id FROM x UNION ALL SELECT t FROM x) GROUP BY 1),
j AS (SELECT n.id, n.c, n.loc, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(crossings, 0) AS crossings FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN k USING (id)),
z AS (SELECT greatest(max(in_degree), 1) AS mi, greatest(max(out_degree), 1) AS mo, greatest(max(crossings), 1) AS mk, greatest(max(loc), 1) AS ml FROM j),
r AS (SELECT id, in_degree, out_degree, crossings, loc, round(in_degree / mi * 0.40 + crossings / mk * 0.30 + loc / ml * 0.20 + out_degree / mo * 0.10, 4) AS risk_score FROM j, z)
"""


@query("edge_referential_semijoin", "J1", "SELECT l_suppkey AS source_id, l_partkey AS target_id, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def edge_referential_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"))
    nodes = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    nodes = nodes.unionByName(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))
    kept = graph.referential(edges, nodes).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.expr("substring(source_id, 2)").cast("long").alias("source_id"), F.expr("substring(target_id, 2)").cast("long").alias("target_id"), "n")


@query("degrees", "A1 K9", f"WITH {_GRAPH_SQL} SELECT id, in_degree, out_degree FROM j WHERE in_degree + out_degree > 0")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.referential(_edges(spark, sf_dir), _nodes(spark, sf_dir))).select("id", "in_degree", "out_degree")


@query("community_crossings", "A2 K2", f"WITH {_GRAPH_SQL} SELECT id, crossings FROM k")
def community_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.crossings(_edges(spark, sf_dir), nodes.select("id", "community"))


@query(
    "graph_risk",
    "A1 A2 A3 A4 A5 G5 K18",
    f"WITH {_GRAPH_SQL} SELECT *, CASE WHEN risk_score < 0.25 THEN 'low' WHEN risk_score < 0.5 THEN 'medium' WHEN risk_score < 0.75 THEN 'high' ELSE 'critical' END AS risk_level FROM r",
)
def graph_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    scored = graph.risk_scores(nodes, _edges(spark, sf_dir).select("source_id", "target_id"), nodes.select("id", "community"))
    return scored.withColumn("loc", F.col("loc").cast("long"))


_PAIRS = "q AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey)"


@query(
    "community_cohesion",
    "A6",
    f"""WITH {_PAIRS}, m AS (SELECT c_nationkey AS community, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1),
    z AS (SELECT community, sum(n)::BIGINT AS size FROM m GROUP BY 1 HAVING sum(n) >= 2), i AS (SELECT c_nationkey AS community, count(*) AS e FROM q JOIN customer ON c = c_custkey GROUP BY 1)
    SELECT community, size, round(coalesce(e, 0) / greatest(1.0, size * (size - 1) / 2), 3) AS cohesion FROM z LEFT JOIN i USING (community)""",
)
def community_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    edges = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("source_id"), (-F.col("l_suppkey") - 1).alias("target_id"))
    members = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community")).unionByName(t("supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_nationkey").alias("community")))
    return graph.cohesion(edges, members)


@query(
    "community_label",
    "A7 F7 K19",
    """WITH s AS (SELECT p_partkey % 25 AS community, lower(p_type) || '_goods' AS seg, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, seg) AS k FROM s)
    SELECT community, upper(left(seg, 1)) || substring(split_part(seg, '_', 1), 2) || ' Goods' AS label FROM r WHERE k = 1""",
)
def community_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lower("p_type"), F.lit("_goods/"), F.col("p_name"))
    return graph.community_labels(table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("community"), path.alias("path")))


def _successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part calls another: the small keys in cycles, the others by a third, so that chains grow with the table."""
    key = F.col("p_partkey")
    target = F.when(key < 97, (key * 7 + F.col("p_size")) % 97).otherwise(F.floor(key / 3))
    return table(spark, sf_dir, "part").select(key.alias("source_id"), target.cast("long").alias("target_id"))


@query(
    "flow_closure",
    "G3",
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS s, CASE WHEN p_partkey < 97 THEN (p_partkey * 7 + p_size) % 97 ELSE p_partkey // 3 END AS t FROM part), c AS (SELECT DISTINCT s AS start, s AS node FROM e UNION SELECT start, t FROM c JOIN e ON node = s)
    SELECT start, node FROM c""",
)
def flow_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_successors(spark, sf_dir)).select("start", "node")


@query(
    "flow_depth",
    "G3 C3",
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS s, CASE WHEN p_partkey < 97 THEN (p_partkey * 7 + p_size) % 97 ELSE p_partkey // 3 END AS t FROM part), c AS (SELECT DISTINCT s AS start, s AS node, 0 AS d FROM e UNION SELECT start, t, d + 1 FROM c JOIN e ON node = s WHERE d < 4)
    SELECT start, node, min(d)::BIGINT AS depth FROM c GROUP BY 1, 2""",
)
def flow_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_successors(spark, sf_dir), 4).select("start", "node", F.col("depth").cast("long").alias("depth"))


@query("communities", "G4")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts by who delivers what; no SQL form, tested by its invariants."""
    edges = _edges(spark, sf_dir).select("source_id", "target_id")
    return graph.communities_by_modularity(_nodes(spark, sf_dir).select("id"), edges)
