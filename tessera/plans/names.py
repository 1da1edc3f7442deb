"""Files, names and texts: documents and pages as repository files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import files
from tessera.registry import query
from tessera.session import table

_EXT = ["py", "ts", "tsx", "go", "md", "JSX", "c", "hpp"]
_DIR = ["src", "node_modules", ".hidden", "lib", "dist"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files `<folder>/<source>/doc_<id>.<extension>`."""
    pick = lambda options, n: F.array(*[F.lit(o) for o in options])[(F.col("doc_id") % n).cast("int")]
    path = F.concat_ws("/", pick(_DIR, len(_DIR)), "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), pick(_EXT, len(_EXT))))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), F.lit("r").alias("repo_id"), path.alias("path"), F.col("text").alias("content"), "lang", "source")


FILES_SQL = f"""f AS (SELECT doc_id, text AS content, source, ({_DIR!r})[doc_id % {len(_DIR)} + 1] || '/' || source || '/doc_' || doc_id || '.' || ({_EXT!r})[doc_id % {len(_EXT)} + 1] AS path FROM documents)"""
_SKIPPED = ", ".join(f"'{s}'" for s in files.SKIPPED_FOLDERS)
_CODE = ", ".join(f"'{s}'" for s in files.CODE_EXTENSIONS)


@query(
    "include_filter",
    "P1 S7 S1",
    f"""WITH {FILES_SQL} SELECT doc_id, path FROM f WHERE len(list_filter(string_split(path, '/')[:-2], lambda s: s IN ({_SKIPPED}) OR s LIKE '.%')) = 0
    AND '.' || lower(regexp_extract(path, '\\.([^.]*)$', 1)) IN ({_CODE}) AND length(content) < {files.MAX_CHARS}""",
)
def include_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(files.is_code(F.col("path"), F.col("content"))).select("doc_id", "path")


@query(
    "detect_language",
    "P2 P3 P4",
    f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'rust' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go'
    WHEN lower(path) LIKE '%.jsx' THEN 'javascript' WHEN path LIKE '%.c' THEN 'c' WHEN path LIKE '%.hpp' THEN 'cpp' END AS language FROM f""",
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("doc_id") % 10 == 0, "Rust").otherwise("klingon")
    return _files(spark, sf_dir).select("doc_id", files.language(F.col("path"), hint).alias("language"))


@query("subsystem_rollup", "P5 A9", f"WITH {FILES_SQL} SELECT split_part(path, '/', 1) AS subsystem, count(*) AS files, count(DISTINCT source) AS sources, sum(length(content))::BIGINT AS chars FROM f GROUP BY 1")
def subsystem_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).groupBy(files.subsystem(F.col("path")).alias("subsystem"))
    return f.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("source").alias("sources"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("readme_and_config", "S20 S21", "SELECT 'package.json' AS name, max_by(left(text, 5000), doc_id) AS content FROM documents UNION ALL SELECT 'readme', min_by(left(text, 8000), doc_id) FROM documents")
def readme_and_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("content"))
    config = files.config_contents(d.withColumn("path", F.lit("a/package.json"))).select("name", "content")
    return config.unionByName(files.readme(d.withColumn("path", F.lit("ReadMe.md"))).select(F.lit("readme").alias("name"), "content"))


@query("branch_resolution", "S4", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'develop' ELSE event_type END AS branch FROM events")
def branch_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_type") == "click", " Main").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", files.branch_or_default(asked, F.lit("develop")).alias("branch"))


@query("line_slice", "P6 K20 K21", "SELECT doc_id, array_to_string(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[2:4], chr(10)) AS content FROM documents")
def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.lines_between(F.col("text"), F.lit(2), F.lit(4)).alias("content"))


@query("embeddable_snippets", "P7", "SELECT doc_id, left(trim(text), 1500) AS snippet FROM documents WHERE length(trim(text)) >= 10")
def embeddable_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.trim("text")
    return table(spark, sf_dir, "documents").where(F.length(body) >= 10).select("doc_id", F.substring(body, 1, 1500).alias("snippet"))


@query(
    "embed_text_builder",
    "F9 F10",
    "SELECT doc_id, 'Function: f' || doc_id || ' | File: ' || source || '/a.py | Calls: ' || lang || ', go' || CASE WHEN doc_id % 2 = 0 THEN ' | Summary: ' || left(text, 20) ELSE '' END || chr(10) || chr(10) || left(text, 40) AS body FROM documents",
)
def embed_text_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    lists = F.array().cast("array<string>")
    body = text.embedding_text(F.concat(F.lit("f"), F.col("doc_id").cast("string")), none, F.concat("source", F.lit("/a.py")), F.lit(""), F.array("lang", F.lit("go")), lists, F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)), lists, F.substring("text", 1, 40))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


@query("content_ids", "F5", "SELECT p_partkey, left(sha1('File:src/' || p_name), 16) AS id FROM part")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.content_id(F.lit("File"), F.concat(F.lit("src/"), "p_name")).alias("id"))


@query("sanitized_names", "F1 F3", "SELECT c_custkey, trim(lower(regexp_replace(c_name || ' / ' || c_mktsegment || '!', '[^A-Za-z0-9]+', '_', 'g')), '_') AS name, lower(replace(c_name, '#', '_')) AS token FROM customer")
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.sanitize_name(raw).alias("name"), text.repo_token(F.col("c_name")).alias("token"))


@query("slugs", "F12", "SELECT p_partkey, 'class-' || trim(regexp_replace(lower(left(p_name || ' ' || p_brand || ' -- ' || p_type, 60)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug("class", F.concat_ws(" ", "p_name", "p_brand", F.lit("--"), "p_type")).alias("slug"))


@query("object_keys", "S11 F31", "SELECT o_orderkey, 'docs/' || o_orderstatus || '/feature_x/' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.json' AS key FROM orders")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(text.object_key("docs", F.col("o_orderstatus"), F.lit("feature/x"), text.stamp(F.col("o_orderdate"))), F.lit(".json"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))


@query("json_extract_fenced", "F23", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_extract_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.fenced_json(raw), "$.k").cast("long").alias("k"))


@query("masked_urls", "F29", "SELECT s_suppkey, 'redis://user:***@host' || s_suppkey || ':6379/0' AS url FROM supplier")
def masked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("redis://user:"), "s_name", F.lit("@host"), F.col("s_suppkey").cast("string"), F.lit(":6379/0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.masked_url(url).alias("url"))


@query("repository_names", "P19 J17", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'org' || s_nationkey || '/repo' || s_suppkey ELSE s_name END AS full_name FROM supplier")
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("s_suppkey") % 2 == 0, "https://github.com/").otherwise("https://example.org/")
    url = F.concat(host, F.lit("org"), F.col("s_nationkey").cast("string"), F.lit("/repo"), F.col("s_suppkey").cast("string"), F.lit(".git"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", files.repository_name(url, F.col("s_name")).alias("full_name"))


@query(
    "cluster_label",
    "A17 F8",
    """WITH w AS (SELECT p_partkey % 10 AS cluster, unnest(string_split(p_name, ' ')) AS word FROM part), c AS (SELECT cluster, word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS k FROM c) SELECT cluster, string_agg(upper(word[1]) || word[2:], ' & ' ORDER BY k) AS label FROM r WHERE k <= 2 GROUP BY 1""",
)
def cluster_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.cluster import cluster_labels

    return cluster_labels(table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("cluster"), F.regexp_replace("p_name", " ", "_").alias("name")))


@query("vector_clusters", "V3")
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters and places in the plane; held against a single-linkage tree built edge by edge in the tests."""
    from tessera.operators.cluster import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("cluster_noise", "A18 V3", """WITH v AS (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) SELECT count(*) AS vectors, true AS all_placed, greatest(2, count(*) // 40)::INT AS least_size, true AS least_held FROM v""")
def cluster_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and noise counted: every vector is in one or the other, and no cluster is smaller than a fortieth of all."""
    from tessera.operators import density

    rows = density.numbered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    count = rows.count()
    least = max(2, count // 40)
    clustered = density.density_clusters(rows, "id", "v", least, blocks=(rows, density.blocked(rows)))
    sizes = clustered.where("cluster >= 0").groupBy("cluster").count().agg(F.coalesce(F.min("count"), F.lit(least)).alias("_s"))
    totals = density.cluster_counts(clustered).join(F.broadcast(sizes))
    return totals.select((F.col("noise") + F.col("members")).alias("vectors"), (F.col("noise") + F.col("members") == count).alias("all_placed"), F.lit(least).alias("least_size"), (F.col("_s") >= least).alias("least_held"))
