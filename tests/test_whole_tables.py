"""Queries without SQL take all rows of their tables."""

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans import graphs

SF = "/root/testdata/sf0.001"


def test_communities_of_all_line_items(spark):
    lines, parts, suppliers = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("lineitem", "part", "supplier"))
    edges = lines.select((-F.col("l_suppkey") - 1).alias("source_id"), F.col("l_partkey").alias("target_id"))
    nodes = parts.select(F.col("p_partkey").alias("id")).union(suppliers.select(-F.col("s_suppkey") - 1))
    want = {r.id: r.community for r in graph.communities_by_modularity(nodes, edges).collect()}
    assert {r.id: r.community for r in graphs.communities(spark, SF).collect()} == want
