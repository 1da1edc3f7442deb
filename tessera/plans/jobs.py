"""Jobs, flags, lookups and what prompts show: the parts between the scans and the services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, pr, prompts, regenerate, store, sync, tree
from tessera.operators.lineage import scratch
from tessera.plans.reviews import _PR
from tessera.plans.trees import _TREE_SQL, _tree
from tessera.registry import query
from tessera.session import table


def _s(c: str):
    return F.col(c).cast("string")


@query("branch_heads", "S2", "SELECT user_id AS repo_id, event_type AS branch, max(event_id)::VARCHAR AS sha FROM events GROUP BY 1, 2")
def branch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with a map of heads per repository, read as rows."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("repo_id"), F.col("event_type").alias("branch")).agg(F.max("event_id").cast("string").alias("sha"))
    maps = last.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("branch", "sha"))).alias("heads"))
    return sync.heads(maps, "heads", "repo_id")


@query(
    "changed_sets",
    "Q4 Q2",
    """WITH h AS (SELECT o_custkey AS repo_id, o_orderkey AS branch, CASE WHEN o_orderkey % 3 <> 0 THEN 'old' END AS old_sha FROM orders), f AS (SELECT l_orderkey AS branch, string_agg(DISTINCT 'p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS files FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT repo_id, h.branch, CASE WHEN old_sha IS NOT NULL THEN coalesce(files, '') END AS files FROM h LEFT JOIN f ON h.branch = f.branch""",
)
def changed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("branch"), F.lit("new").alias("sha"), F.when(F.col("o_orderkey") % 3 != 0, "old").alias("old_sha"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(o.select("repo_id", "branch"), F.col("l_orderkey") == F.col("branch")).select("repo_id", "branch", F.concat(F.lit("p"), _s("l_partkey")).alias("path"))
    return sync.changed_sets(o, li, "repo_id").select("repo_id", "branch", F.array_join("files", ",").alias("files"))


@query("queued_jobs", "Q6 Q5 Q10", "SELECT kind, count(*) AS jobs, count(*) FILTER (key % 2 = 0) AS even FROM (SELECT DISTINCT 'documentation' AS kind, l_orderkey AS key FROM lineitem WHERE l_partkey % 97 = 5 UNION ALL SELECT DISTINCT 'diagram', l_suppkey FROM lineitem WHERE l_partkey % 97 = 5) GROUP BY 1")
def queued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by order and diagrams by supplier that use a changed part: a job each, and the counters of the run."""
    li, path = table(spark, sf_dir, "lineitem"), F.array(F.col("l_partkey").cast("string")).alias("file_paths")
    changed = table(spark, sf_dir, "part").where("p_partkey % 97 = 5").select(_s("p_partkey").alias("path"))
    jobs = sync.jobs_of(li.select(F.col("l_orderkey").alias("id"), path), changed, "documentation").unionByName(sync.jobs_of(li.select(F.col("l_suppkey").alias("id"), path), changed, "diagram"))
    return jobs.groupBy("kind").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("key") % 2 == 0).alias("even"))


@query("isolated_runs", "Q3 Q10", "SELECT r_name AS branch, CASE WHEN r_regionkey = 2 THEN 'failed: ValueError' ELSE 'done' END AS status, CASE WHEN r_regionkey = 2 THEN 0 ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS done FROM region")
def isolated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each branch; that of the third fails and the others are done."""
    regions = {r["r_name"]: r["r_regionkey"] for r in table(spark, sf_dir, "region").collect()}  # five rows

    def job(branch: str) -> int:
        if regions[branch] == 2:
            raise ValueError(branch)
        return table(spark, sf_dir, "nation").where(F.col("n_regionkey") == regions[branch]).count()

    return spark.createDataFrame(sync.run_each(sorted(regions), job), "branch string, status string, done long")


@query("inserted_documents", "D4", "SELECT p_partkey, p_name, false AS needs_sync, false AS is_updating FROM part")
def inserted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.new_documents(table(spark, sf_dir, "part").select("p_partkey", "p_name"))


@query("cleared_flags", "D6", "SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS needs_sync, p_partkey % 3 <> 0 AS is_updating, CASE WHEN p_partkey % 6 = 0 THEN 'new' ELSE p_name END AS title FROM part")
def cleared_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags go off for every third document, the title is replaced for every sixth."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (k % 2 == 0).alias("needs_sync"), F.lit(True).alias("is_updating"), F.col("p_name").alias("title"))
    payload = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(k.alias("id"), F.when(k % 6 == 0, "new").alias("title"))
    return store.cleared(rows, payload, "id", "title")


@query("existing_titles", "D9 S19", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title, p_type AS description, p_brand FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def existing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions of one repository, nulls as empty texts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("title"), F.col("p_type").alias("description"), "p_brand")
    first = rows.agg(F.min("p_brand").alias("b")).first()["b"]
    return store.listed(rows, "title", "description", p_brand=first)


@query(
    "collection_lookup",
    "J17",
    """SELECT s_suppkey AS collection, r_name AS organization, CASE WHEN r_name IS NOT NULL THEN n_name END AS repository, CASE WHEN r_name IS NULL THEN 'organization not found' WHEN n_name IS NULL THEN 'repository not found' END AS error
    FROM supplier LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON r_regionkey = s_suppkey % 5 LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = s_suppkey % 5""",
)
def collection_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("collection"), (F.col("s_suppkey") % 5).cast("int").alias("short_id"), F.col("s_nationkey").alias("token"))
    orgs = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("short_id"), F.col("r_name").alias("organization"))
    found = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("short_id"), F.col("n_nationkey").alias("token"), F.col("n_name").alias("repository"))
    rows = store.looked_up(c, orgs, found)
    return rows.withColumn("repository", F.when(F.col("organization").isNotNull(), F.col("repository")))


@query(
    "community_members",
    "A8 J16 A20",
    """WITH m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_nationkey END AS community FROM customer), s AS (SELECT community, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 2)
    SELECT id, m.community::BIGINT AS community, s.size FROM m JOIN s ON m.community = s.community""",
)
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of two or more as nodes and MEMBER_OF edges, and back from the edges."""
    k = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 10 == 0, -k).otherwise(F.col("c_nationkey")).alias("community"))
    nodes, edges = graph.community_graph(members)
    back = graph.communities_of(edges)
    return back.join(nodes.select(F.regexp_replace("id", "comm_", "").cast("long").alias("community"), "size"), "community").select("id", "community", "size")


@query(
    "tree_graft",
    "J12 J15",
    f"""WITH {_TREE_SQL}, d AS (SELECT path, 'S ' || name AS summary, 'D ' || name AS description FROM t WHERE length(path) % 3 = 0)
    SELECT t.path, CASE WHEN t.type = 'folder' THEN 'own' ELSE d.summary END AS summary, d.description, d.path IS NULL AS asked_again FROM t LEFT JOIN d USING (path)""",
)
def tree_graft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said of a path is put onto the real tree, whose own words stay; paths of which nothing was said are asked again."""
    t = _tree(spark, sf_dir).select("path", "name", "type", F.when(F.col("type") == "folder", "own").alias("summary"), F.lit(None).cast("string").alias("description"))
    said = t.where(F.length("path") % 3 == 0).select("path", F.concat(F.lit("S "), "name").alias("summary"), F.concat(F.lit("D "), "name").alias("description"))
    again = tree.missing(t, said).withColumn("asked_again", F.lit(True))
    return tree.graft(t, said).join(again, "path", "left").select("path", "summary", "description", F.coalesce("asked_again", F.lit(False)).alias("asked_again"))


@query("compact_tree", "T13", f"WITH {_TREE_SQL}, f AS (SELECT path FROM t WHERE type = 'file' ORDER BY path LIMIT 500), r AS (SELECT 'folder' AS kind, path FROM t WHERE parent IS NULL AND type = 'folder' ORDER BY path LIMIT 80), o AS (SELECT 'file' AS kind, path FROM t WHERE parent IS NULL AND type = 'file' ORDER BY path LIMIT 60) SELECT 'compact' AS kind, path, 20 AS symbols FROM f UNION ALL SELECT kind, path, 0 FROM r UNION ALL SELECT kind, path, 0 FROM o")
def compact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits are what a prompt shows: 500 files with 20 names each, 80 folders and 60 files of the root."""
    t = _tree(spark, sf_dir)
    symbols = t.where("type = 'file'").select("path", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("start_line")).withColumn("name", F.concat(F.lit("f"), _s("start_line")))
    shown = tree.compact(t, symbols).select(F.lit("compact").alias("kind"), "path", F.size("symbols").alias("symbols"))
    return shown.unionByName(tree.top_folders(t).withColumn("symbols", F.lit(0)))


_PATCHED = f"x AS (SELECT {_PR} AS pr_number, l_orderkey * 10 + l_linenumber AS file, l_partkey % 3 <> 0 AS patched FROM lineitem), u AS (SELECT DISTINCT pr_number, file FROM x WHERE patched)"


def _patch() -> Column:
    """The patch of a file of ``_patched``."""
    return F.concat(F.lit("@@ -1 +1 @@\n"), F.repeat(F.lit("+line\n"), F.col("lines")))


def _patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr_number, file_path, lines); ``_patch`` makes a patch of the last."""
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    size = F.floor(F.col("l_orderkey") / 100) % 7
    pr_number = (F.floor(F.col("l_orderkey") / (size + 1)) * 7 + size).alias("pr_number")
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 3 != 0").select(pr_number, F.format_string("%012d", number).alias("file_path"), (F.col("l_orderkey") % 700).cast("int").alias("lines"))
    return rows.distinct()


@query("pr_prompt_files", "T15 P9", f"WITH {_PATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY pr_number ORDER BY file) AS rank FROM u) SELECT pr_number, file, rank, least(2000, 11 + 6 * least(file // 10 % 700, 498) + 1 + CASE WHEN file // 10 % 700 > 498 THEN 5 ELSE 0 END) AS size FROM r WHERE rank <= 15")
def pr_prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen changed files of a request, 500 lines and 2000 signs of each."""
    shown = pr.prompt_files(_patched(spark, sf_dir), patch=_patch())
    return shown.select("pr_number", F.col("file_path").cast("long").alias("file"), "rank", F.length("patch").alias("size"))


@query("pr_context_queries", "T7", f"WITH {_PATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY pr_number ORDER BY file) AS rank FROM u) SELECT pr_number, 'PR ' || pr_number || ' ' || string_agg(lpad(file::VARCHAR, 12, '0'), ' ' ORDER BY file) AS query FROM r WHERE rank <= 3 GROUP BY 1")
def pr_context_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _patched(spark, sf_dir).withColumn("title", F.concat(F.lit("PR "), _s("pr_number")))
    return pr.context_query(files)


@query("agent_rules", "F28", "SELECT p_partkey, '----' || chr(10) || 'role: ' || p_brand || chr(10) || 'context: ' || p_type || chr(10) || '----' AS head FROM part")
def agent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = prompts.rule_document(F.col("p_brand"), F.concat(F.lit(" "), "p_type"), F.col("p_name"), F.lit("Body"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(text, r"(?s)^(----\n.*?\n----)", 1).alias("head"))


@query(
    "regenerated_documents",
    "Q11 Q10 J18 A13 K26",
    """WITH h AS (SELECT l_suppkey AS doc_id, l_returnflag AS collection, l_returnflag = 'N' AS own, l_extendedprice AS score, l_orderkey || ':' || l_linenumber AS chunk, CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE 'p' || l_partkey % 50 END AS path FROM lineitem WHERE l_suppkey % 7 <> 0 OR l_returnflag <> 'N'),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN own THEN '' ELSE collection END ORDER BY score DESC, chunk) AS r FROM h QUALIFY r <= CASE WHEN own THEN 20 ELSE 5 END),
    c AS (SELECT doc_id, string_agg(chunk, ',' ORDER BY NOT own, CASE WHEN own THEN '' ELSE collection END, score DESC, chunk) AS context, string_agg(DISTINCT path, ',' ORDER BY path) FILTER (path <> ' ') AS paths FROM b GROUP BY 1 HAVING bool_or(own)),
    d AS (SELECT s_suppkey AS doc_id, s_suppkey % 3 = 0 AS stale, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS prompt FROM supplier),
    e AS (SELECT d.*, context, paths, CASE WHEN NOT stale THEN NULL WHEN prompt = '' THEN 'no stored prompt' WHEN context IS NULL THEN 'no chunks' END AS error FROM d LEFT JOIN c USING (doc_id))
    SELECT doc_id, CASE WHEN stale AND error IS NULL THEN prompt || ': ' || context ELSE 'old' END AS text, CASE WHEN stale AND error IS NULL THEN paths ELSE 'was' END AS file_paths, stale AND error IS NOT NULL AS needs_sync, false AS is_updating, error FROM e""",
)
def regenerated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents, their lines as chunks. The run that has written its intents dies; the next one finishes it."""
    k = F.col("s_suppkey")
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").where("l_suppkey % 7 != 0 or l_returnflag != 'N'")
    at = scratch(spark, "regenerated")
    stores = regenerate.Stores(*[store.VersionedTable(spark, f"{at}/{name}") for name in ("texts", "metadata", "log")])
    stores.texts.write(s.select(k.alias("doc_id"), F.lit("old").alias("text")))
    stores.metadata.write(s.select(k.alias("doc_id"), F.array(F.lit("was")).alias("file_paths"), (k % 3 == 0).alias("needs_sync"), (k % 3 == 0).alias("is_updating"), F.lit(None).cast("string").alias("error")))
    path = F.when(F.col("l_partkey") % 50 == 0, " ").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")))
    hits = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("collection"), (F.col("l_returnflag") == "N").alias("own"), F.col("l_extendedprice").alias("score"), F.concat_ws(":", _s("l_orderkey"), _s("l_linenumber")).alias("chunk"), path.alias("path"))
    prompts = s.select(k.alias("doc_id"), F.when(k % 9 == 0, "").otherwise(F.col("s_name")).alias("prompt"))
    make = lambda prompt, chunks: F.concat(prompt, F.lit(": "), F.array_join(chunks, ","))
    stale = stores.metadata.read().where("needs_sync").select("doc_id").join(prompts, "doc_id")
    regenerate.begin(stores, regenerate.intents(stale, regenerate.context(hits), make))
    regenerate.finish(stores)
    done = stores.metadata.read().join(stores.texts.read(), "doc_id")
    return done.select("doc_id", "text", F.array_join("file_paths", ",").alias("file_paths"), "needs_sync", "is_updating", "error")
