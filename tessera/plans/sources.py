"""Round trips through the sources and sinks: what is written from the tables is read again by the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vector
from tessera.operators.files import is_code
from tessera.operators.lineage import scratch
from tessera.plans.extraction import _LETTERS, _letters
from tessera.registry import query
from tessera.session import table
from tessera.sources import embeddings, repos


def _s(c: str):
    return F.col(c).cast("string")


@query("report_sink", "S8", "SELECT p_partkey, p_name, p_brand AS repo, 'main' AS branch, '20240101_000000' AS run, 'chunks' AS kind FROM part UNION ALL SELECT s_suppkey, s_name, 'r' || s_nationkey, 'main', '20240101_000000', 'symbols' FROM supplier")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a run as JSON below repository, branch and run."""
    base = scratch(spark, "report")
    chunks = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("repo"), F.lit("main").alias("branch"))
    symbols = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_name"), F.concat(F.lit("r"), _s("s_nationkey")).alias("repo"), F.lit("main").alias("branch"))
    repos.write_report({"chunks": chunks, "symbols": symbols}, base, "20240101_000000", "repo", "branch")
    read = [spark.read.json(f"{base}/{n}").withColumn("kind", F.lit(n)) for n in ("chunks", "symbols")]
    return read[0].unionByName(read[1])


@query(
    "document_sink",
    "S9 S10 F27",
    """SELECT n_name AS key, CASE WHEN n_nationkey = 3 THEN '# New' || chr(10) || 'text' ELSE '# ' || n_name || chr(10) || chr(10) || 'Of region ' || n_regionkey END AS text, n_regionkey AS region FROM nation WHERE n_nationkey % 5 <> 0""",
)
def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and metadata by key: put, put again, delete; a key that is gone is not there."""
    base, meta = scratch(spark, "documents"), scratch(spark, "metadata")
    text = F.concat(F.lit("# "), "n_name", F.lit("\n\nOf region "), _s("n_regionkey"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), text.alias("text"), F.col("n_regionkey").alias("region"), "n_nationkey")
    repos.write_documents(rows.drop("n_nationkey"), base, meta)
    repos.write_documents(rows.where("n_nationkey = 3").select("key", F.lit("# New\ntext").alias("text"), "region"), base, meta)
    for key in [r["key"] for r in rows.where("n_nationkey % 5 = 0").select("key").collect()]:  # a handful of deletions
        assert repos.delete_document(spark, base, key) and not repos.document_exists(spark, base, key)
    described = spark.read.json(meta).select("key", F.col("region").cast("int").alias("region"))
    return repos.read_documents(spark, base).join(described, "key")


@query("chunk_file_scan", "S12", "SELECT 'c' || p_partkey AS id, p_type AS type, p_name AS content FROM part")
def chunk_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk files are JSON arrays; here each holds a hundred chunks."""
    path = scratch(spark, "chunk-files")
    chunk = F.struct(F.concat(F.lit("c"), _s("p_partkey")).alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("content"))
    arrays = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("file")).agg(F.to_json(F.collect_list(chunk)).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return repos.chunk_file(spark, f"{path}/*/*.txt", "id string, type string, content string")


@query("collection_copy", "S13 S14 S15 V4", "SELECT 'l' || label AS collection, count(*) AS points FROM embeddings GROUP BY 1 UNION ALL SELECT 'copy', count(*) FROM embeddings WHERE label = 1")
def collection_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection under a second name next to the others; copying onto one that exists is refused."""
    path = scratch(spark, "vectors")
    points = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("l"), _s("label")).alias("collection"), vector.point_id(_s("vec_id")).alias("point_id"), F.col("embedding").alias("vector"))
    repos.write_vectors(points, path)
    stored = spark.read.parquet(path)
    repos.write_vectors(repos.copy_collection(stored, "l1", "copy"), path)
    stored = spark.read.parquet(path)
    try:
        repos.copy_collection(stored, "l1", "copy")
    except ValueError:
        return stored.groupBy("collection").agg(F.count(F.lit(1)).alias("points"))
    raise AssertionError("a collection was written over")


@query(
    "graph_store",
    "S16 S17 S18 J19 J20 G6 Q8b",
    """WITH e AS (SELECT 'r' || l_suppkey % 4 AS repo, 's' || l_suppkey AS s, 's' || (l_suppkey + 4) AS t FROM lineitem), n AS (SELECT 'r' || s_suppkey % 4 AS repo, 's' || s_suppkey AS id FROM supplier),
    k AS (SELECT e.* FROM e WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)), c AS (SELECT repo, count(*) AS nodes FROM n GROUP BY 1)
    SELECT c.repo, c.nodes, CASE WHEN c.repo = 'r1' THEN 0 ELSE (SELECT count(*) FROM k WHERE k.repo = c.repo) END AS edges FROM c WHERE c.repo <> 'r2' UNION ALL SELECT 'r2', -1, -1 UNION ALL SELECT 'none', -1, -1""",
)
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the graphs of four repositories, one again without edges, delete one, read all; -1 where there is none."""
    base = scratch(spark, "graph")
    k = F.col("s_suppkey")
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), (k % 4).cast("string")).alias("repo_id"), F.concat(F.lit("s"), k.cast("string")).alias("id"))
    k = F.col("l_suppkey")
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), (k % 4).cast("string")).alias("repo_id"), F.lit("CALLS").alias("type"), F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.concat(F.lit("s"), (k + 4).cast("string")).alias("target_id"))
    repos.write_graph(nodes, edges, base)
    repos.write_graph(nodes.where("repo_id = 'r1'"), edges.where("false"), base)
    repos.delete_graph(spark, base, "r2")
    counts = []
    for repo in ("r0", "r1", "r2", "r3", "none"):
        got = repos.read_graph(spark, base, repo)
        assert repos.graph_exists(spark, base, repo) == (got is not None) != repos.needs_graph(spark, base, repo)
        missing = spark.range(1).select(F.lit(repo).alias("repo"), F.lit(-1).cast("long").alias("nodes"), F.lit(-1).cast("long").alias("edges"))
        if got:
            n, e = (d.agg(F.count(F.lit(1)).alias(name)) for d, name in zip(got, ("nodes", "edges")))
            missing = n.join(e).select(F.lit(repo).alias("repo"), "nodes", "edges")
        counts.append(missing)
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("index_guards", "Q8 Q8b S13", "SELECT 'l1' AS collection, count(*) AS points, false AS needed FROM embeddings WHERE label = 1 UNION ALL SELECT 'gone', -1, true")
def index_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with points is not indexed again; one that is not there is."""
    path = scratch(spark, "guards")
    repos.write_vectors(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("l"), _s("label")).alias("collection"), "vec_id"), path)
    rows = [(c, repos.vector_count(spark, path, c), repos.needs_index(spark, path, c)) for c in ("l1", "gone")]
    return spark.createDataFrame(rows, "collection string, points long, needed boolean")


@query(
    "pull_request_scan",
    "S5 P9 A14",
    """WITH f AS (SELECT c_nationkey AS pr, c_name, CASE WHEN c_custkey % 3 <> 0 THEN 1 END AS patched, c_custkey % 50 AS additions FROM customer)
    SELECT n_nationkey::BIGINT AS pr_number, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'text' ELSE '' END AS description, 'main' AS base_branch, 'u' || n_regionkey AS author, count(patched) AS files, sum(additions) FILTER (patched = 1)::BIGINT AS additions FROM nation JOIN f ON pr = n_nationkey GROUP BY ALL""",
)
def pull_request_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of requests and one of files for each, as a service answers them; files without a patch are left out."""
    requests, files = scratch(spark, "requests"), scratch(spark, "request-files")
    n = table(spark, sf_dir, "nation")
    ref = lambda value: F.struct(value.alias("ref"))
    row = F.struct(F.col("n_nationkey").alias("number"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "text").alias("body"), ref(F.lit("main")).alias("base"), ref(F.lit("dev")).alias("head"), F.struct(F.concat(F.lit("u"), _s("n_regionkey")).alias("login")).alias("user"), F.lit("2024-01-01").alias("updated_at"))
    n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(row)).alias("value")).select("value", "n_regionkey").write.partitionBy("n_regionkey").text(requests)
    file = F.struct(F.col("c_name").alias("filename"), F.lit("modified").alias("status"), (F.col("c_custkey") % 50).alias("additions"), F.lit(0).alias("deletions"), F.when(F.col("c_custkey") % 3 != 0, "@@ -1 +1 @@").alias("patch"))
    table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("pr")).agg(F.to_json(F.collect_list(file)).alias("value")).write.partitionBy("pr").text(files)
    asked = repos.pull_requests(spark, f"{requests}/*/*.txt")
    number = F.regexp_extract(F.input_file_name(), "pr=([0-9]+)", 1).cast("long")
    changed = repos.pull_request_files(spark, f"{files}/*/*.txt", number).where("patch != ''").groupBy("pr_number").agg(F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"))
    return asked.select("pr_number", "title", "description", "base_branch", "author").join(changed, "pr_number")


@query("contributors_scan", "S6 J17", "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 's' || s_suppkey ELSE s_name END AS name, 's' || s_suppkey AS login, (s_suppkey * 37 % 101)::VARCHAR AS contributions, 'r' AS repo FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY s_suppkey * 37 % 101 DESC, login LIMIT 10")
def contributors_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most active people of a listing; the login where there is no name."""
    path = scratch(spark, "contributors")
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("login"), F.when(k % 3 == 0, "Bot").otherwise("User").alias("type"), (k * 37 % 101).alias("contributions"), F.when(k % 4 != 0, F.col("s_name")).alias("name"))
    rows.write.json(path)
    return repos.contributors(spark.read.schema(repos.CONTRIBUTOR_SCHEMA).json(path), "r")


@query(
    "repository_scan",
    "S1 S7 P1",
    """WITH f AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'node_modules/' ELSE 'src/' END || 'r' || n_regionkey || '/n' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN '.md' ELSE '.py' END AS path, '# ' || n_name AS content FROM nation),
    o AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS ordinal FROM f) SELECT path, content, ordinal FROM o WHERE path LIKE 'src/%.py'""",
)
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked-out tree of small files, read with its paths and filtered like the scan of a service."""
    base = scratch(spark, "tree")
    for r in table(spark, sf_dir, "nation").collect():  # 25 files
        k = r["n_nationkey"]
        folder, end = ("node_modules" if k % 4 == 0 else "src"), ("md" if k % 3 == 0 else "py")
        repos._put(spark, f"{base}/{folder}/r{r['n_regionkey']}/n{k}.{end}", f"# {r['n_name']}")
    files = repos.repository_files(spark, base, "r", "main")
    return files.where(is_code(F.col("path"), F.col("content"))).where("path like '%.py'").select("path", "content", "ordinal")


_QUESTION = "where are the orders stored and sent"


@query(
    "text_search",
    "T2 S22 V1",
    f"""WITH q AS (SELECT {_LETTERS.format(f"'{_QUESTION}'")} AS v), d AS (SELECT p_partkey, {_LETTERS.format("p_name || ' ' || p_type || ' ' || p_brand")} AS v FROM part),
    s AS (SELECT p_partkey, round(list_cosine_similarity(d.v::DOUBLE[], q.v::DOUBLE[]), 6) AS score FROM d, q) SELECT p_partkey, score FROM s ORDER BY score DESC, p_partkey LIMIT 15""",
)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text as the query: embedded by the model that embedded the rows, then the nearest of them."""
    load = lambda: _letters
    rows = table(spark, sf_dir, "part").select("p_partkey", embeddings.embed_column(F.concat_ws(" ", "p_name", "p_type", "p_brand"), load).cast("array<double>").alias("v"))
    asked = spark.range(1).select(embeddings.embed_column(F.lit(_QUESTION), load).cast("array<double>").alias("q"))
    scored = vector.similar_to(rows, asked, "v").withColumn("score", F.round("score", 6))
    return vector.top_k(scored, 15, "p_partkey").select("p_partkey", "score")
