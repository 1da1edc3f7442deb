"""Retrieval over the embeddings: the label is the collection, paths and symbols follow from the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieve, vector
from tessera.registry import query
from tessera.session import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = vector.similar_to(vectors, one, "embedding").select("vec_id", F.col("label").alias("collection"), F.round("score", 6).alias("score"))
    n = F.col("vec_id")
    return scored.select(
        "*",
        F.concat(F.lit("src/m"), (n % 7).cast("string"), F.lit(".py")).alias("file_path"),
        F.when(n % 3 == 0, F.concat(F.lit("Class"), (n % 5).cast("string"))).alias("class_name"),
        F.when(n % 3 != 2, F.concat(F.lit("fn"), (n % 11).cast("string"))).alias("function_name"),
    )


_SCORED = """
s AS (
  SELECT vec_id, label AS collection, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score,
    'src/m' || (vec_id % 7) || '.py' AS file_path,
    CASE WHEN vec_id % 3 = 0 THEN 'Class' || (vec_id % 5) END AS class_name,
    CASE WHEN vec_id % 3 <> 2 THEN 'fn' || (vec_id % 11) END AS function_name
  FROM embeddings
), r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, vec_id) AS rank FROM s)
"""
_HOT = f"WITH {_SCORED}, h AS (SELECT * FROM r WHERE rank <= 8 ORDER BY score DESC, vec_id LIMIT 30)"


@query("hot_zones_files", "V1 T3 A12", f"{_HOT} SELECT file_path, round(sum(score), 5) AS score FROM h GROUP BY 1")
def hot_zones_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.hot_hits(_scored(spark, sf_dir), "collection", "vec_id")
    return retrieve.file_scores(hits).withColumn("score", F.round("score", 5))


@query(
    "hot_zones_symbols",
    "V1 T3 A12",
    f"{_HOT} SELECT file_path, coalesce(class_name, function_name) AS symbol, round(sum(score), 5) AS score FROM h WHERE coalesce(class_name, function_name) IS NOT NULL GROUP BY 1, 2",
)
def hot_zones_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.hot_hits(_scored(spark, sf_dir), "collection", "vec_id")
    return retrieve.symbol_scores(hits).withColumn("score", F.round("score", 5))


@query("vector_topk", "V1 T1", f"WITH {_SCORED} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(_scored(spark, sf_dir), 5, "vec_id").select("vec_id", "score")


@query("vector_topk_filtered", "T1 P8", f"WITH {_SCORED} SELECT vec_id, score FROM s WHERE collection = 3 ORDER BY score DESC, vec_id LIMIT 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(_scored(spark, sf_dir), 5, "vec_id", where={"collection": 3}).select("vec_id", "score")


@query(
    "compass_topk",
    "T4",
    f"WITH {_SCORED}, n AS (SELECT greatest(4, 15 // greatest(count(DISTINCT collection), 1)) AS k FROM s) SELECT vec_id, collection, score FROM r, n WHERE rank <= k ORDER BY score DESC, vec_id LIMIT 15",
)
def compass_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.compass_hits(_scored(spark, sf_dir), "collection", 15, "vec_id").select("vec_id", "collection", "score")


@query("onboarding_concat_40", "T5 T11", f"WITH {_SCORED} SELECT vec_id, collection, score FROM r WHERE rank <= 12 ORDER BY collection, rank LIMIT 40")
def onboarding_concat_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.concatenated(_scored(spark, sf_dir), "collection", 12, 40, "vec_id").select("vec_id", "collection", "score")


@query("rag_context_files", "T6 J18 A13", f"WITH {_SCORED} SELECT DISTINCT collection, file_path FROM r WHERE rank <= CASE WHEN collection = 2 THEN 20 ELSE 5 END")
def rag_context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.context_hits(_scored(spark, sf_dir), "collection", 2, 20, 5, "vec_id")
    return hits.select("collection", "file_path").distinct()


@query(
    "minmax_scale",
    "F11",
    """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
    SELECT vec_id, round((x - x0) / greatest(x1 - x0, 1e-6) * 2 - 1, 6) AS x, round((y - y0) / greatest(y1 - y0, 1e-6) * 2 - 1, 6) AS y FROM v, m""",
)
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xy")])
    ends = v.agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    scaled = [F.round((F.col(c) - F.col(f"{c}0")) / F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1e-6)) * 2 - 1, 6).alias(c) for c in "xy"]
    return v.join(F.broadcast(ends)).select("vec_id", *scaled)


@query("collection_counts", "V4", "SELECT label AS collection, count(*) AS points, any_value(len(embedding))::BIGINT AS dim FROM embeddings GROUP BY 1")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("collection")).agg(F.count(F.lit(1)).alias("points"), F.any_value(F.size("embedding")).cast("long").alias("dim"))


@query(
    "point_upsert_latest",
    "D8 F6",
    """SELECT 'u' || user_id || ':' || event_type AS chunk_id, max_by(event_id, event_id) AS event_id, max_by(round(value, 2), event_id) AS value FROM events GROUP BY 1""",
)
def point_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("chunk_id"), "event_id", F.round("value", 2).alias("value"), (F.col("event_id") % 2).alias("batch"))
    return vector.upsert_points(e.where("batch = 0").drop("batch"), e.where("batch = 1").drop("batch"), "chunk_id", "event_id").select("chunk_id", "event_id", "value")


_UUID5 = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({0}))"


@query(
    "point_ids",
    "F6 D8",
    f"""WITH h AS (SELECT p_partkey, {_UUID5.format("'src/p.py:' || p_partkey")} AS h FROM part)
    SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", vector.point_id(F.concat(F.lit("src/p.py:"), F.col("p_partkey").cast("string"))).alias("point_id"))


_COLLECTIONS = """c AS (SELECT r_name, n_name, replace(lower(r_name), ' ', '_') || '_' || 'o' || n_regionkey || '_' || lower(n_name) || '_main' AS name, 'org-O' || n_regionkey AS short_id FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import collection_name

    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    short = F.concat(F.lit("o"), F.col("n_regionkey").cast("string"))
    name = collection_name(F.col("r_name"), short, F.col("n_name"), F.lit("main"))
    return joined.select("r_name", "n_name", name.alias("name"), F.concat(F.lit("org-O"), F.col("n_regionkey").cast("string")).alias("short_id"))


@query("org_collections", "P13 P18 F1 F2", f"WITH {_COLLECTIONS} SELECT name FROM c WHERE short_id = 'org-O2'")
def org_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collections(spark, sf_dir).where(vector.organization_matches(F.col("short_id"), "o2 ")).select("name")


@query(
    "repo_filter_fallback",
    "P14 F3 F4 K16 K17",
    f"""WITH {_COLLECTIONS} SELECT 'hit' AS asked, name FROM c WHERE contains(regexp_extract(name, '^[^_]*_[^_]*_(.*)_[^_]*$', 1), 'nation_1') UNION ALL SELECT 'miss', name FROM c""",
)
def repo_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collections(spark, sf_dir).select("name")
    return vector.collections_for(c, ["Nation-1"]).select(F.lit("hit").alias("asked"), "name").unionByName(vector.collections_for(c, ["absent"], by_label=True).select(F.lit("miss").alias("asked"), "name"))


@query("repo_labels", "F4 K16", f"WITH {_COLLECTIONS} SELECT name, regexp_extract(name, '^[^_]*_[^_]*_(.*)_[^_]*$', 1) AS slug, replace(regexp_extract(name, '^[^_]*_[^_]*_(.*)_[^_]*$', 1), '_', '-') AS label FROM c")
def repo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import repo_label, repo_slug

    return _collections(spark, sf_dir).select("name", repo_slug(F.col("name")).alias("slug"), repo_label(F.col("name")).alias("label"))
