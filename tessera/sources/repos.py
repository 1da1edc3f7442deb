"""Where data comes from and goes to: repositories, reviews, contributors, chunk files, reports, vectors, graphs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.graph import referential

PR_SCHEMA = "number long, title string, body string, base struct<ref:string>, head struct<ref:string>, user struct<login:string>, updated_at string"
PR_FILE_SCHEMA = "filename string, status string, additions int, deletions int, patch string"
CONTRIBUTOR_SCHEMA = "login string, type string, contributions long, name string"
# Fixed value: edge types a graph store takes.
EDGE_TYPES = ("CONTAINS", "CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "HAS_METHOD", "MEMBER_OF", "PROCESS_STEP")


def repository_files(spark: SparkSession, folder: str, repo_id: str, branch: str, glob: str = "*") -> DataFrame:
    """(repo_id, branch, ordinal, path, content) of every text file below ``folder``.

    ``ordinal`` is the place of the path among the paths of the repository in their order; the window that counts them
    sees paths only, never contents."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = f"(?i)^.*?{_quoted(folder)}/"
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), root, "")
    places = raw.select(path.alias("path")).select("path", (F.row_number().over(Window.partitionBy(F.lit(repo_id)).orderBy("path")) - 1).cast("long").alias("ordinal"))
    rows = raw.select(F.lit(repo_id).alias("repo_id"), F.lit(branch).alias("branch"), path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    return rows.join(places, "path").select("repo_id", "branch", "path", "content", "ordinal")


def _quoted(folder: str) -> str:
    return r"\Q" + re.sub("^[a-z]+:/*", "/", folder).rstrip("/") + r"\E"


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PR_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.col("number").alias("pr_number"), "title", F.coalesce("body", F.lit("")).alias("description"), F.col("base.ref").alias("base_branch"), F.col("head.ref").alias("head_branch"), F.col("user.login").alias("author"), "updated_at")


def pull_request_files(spark: SparkSession, path: str, pr_number: Column) -> DataFrame:
    raw = spark.read.schema(PR_FILE_SCHEMA).option("multiLine", True).json(path)
    return raw.select(pr_number.alias("pr_number"), F.col("filename").alias("file_path"), "status", F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), F.coalesce("patch", F.lit("")).alias("patch"))


def contributors(rows: DataFrame, repo: str, most: int = 10) -> DataFrame:
    """The ``most`` active people: accounts of type User only, the login where there is no name, counts as text."""
    people = rows.where("type = 'User'").orderBy(F.desc("contributions"), "login").limit(most)
    return people.select(F.coalesce("name", "login").alias("name"), "login", F.col("contributions").cast("string").alias("contributions"), F.lit(repo).alias("repo"))


def chunk_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(tables: dict[str, DataFrame], base: str, run: str, *partition_by: str) -> None:
    """Each table as JSON below ``base``/<name>, a partition of its own for the run."""
    for name, df in tables.items():
        df.withColumn("run", F.lit(run)).write.mode("append").partitionBy(*partition_by, "run").json(f"{base}/{name}")


def write_documents(rendered: DataFrame, path: str, metadata: str | None = None) -> None:
    """One text per row, with its key as a partition so that a key can be read alone; other keys stay. The other columns go
    to ``metadata`` as JSON, by key as well."""
    rendered.select("key", "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\0").partitionBy("key").text(path)
    if metadata:
        rendered.drop("text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").json(metadata)


def read_document(spark: SparkSession, path: str, key: str) -> DataFrame:
    return read_documents(spark, path).where(F.col("key") == key)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of all documents."""
    return spark.read.text(path, lineSep="\0").select(F.col("key").cast("string").alias("key"), F.col("value").alias("text"))


def copy_collection(vectors: DataFrame, source: str, target: str) -> DataFrame:
    """The rows of ``source`` under the name ``target``; refused if the target has rows."""
    if not vectors.where(F.col("collection") == target).isEmpty():
        raise ValueError(f"collection {target} exists")
    return vectors.where(F.col("collection") == source).withColumn("collection", F.lit(target))


def storable_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a graph store takes: all nodes, edges of known types between stored nodes."""
    return nodes, referential(edges.where(F.col("type").isin(*EDGE_TYPES)), nodes)


def write_graph(nodes: DataFrame, edges: DataFrame, base: str) -> None:
    """Replace the graphs of the repositories that occur in ``nodes``, and no others; ``repo_id`` is the partition.

    A repository that has nodes but no edges any more loses its old edges."""
    spark = nodes.sparkSession
    stored, links = storable_graph(nodes, edges)
    # one row for each repository written
    bare = nodes.select("repo_id").distinct().join(links.select("repo_id").distinct(), "repo_id", "left_anti").collect()
    for name, df in (("nodes", stored), ("edges", links)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{base}/{name}")
        # a store without any rows left has no file to take the schema from
        _put(spark, f"{base}/{name}/_schema.json", df.schema.json())
    for row in bare:
        _delete(spark, f"{base}/edges/repo_id={row['repo_id']}")


def _put(spark: SparkSession, path: str, text: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _delete(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_graph(spark: SparkSession, base: str, repo_id: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of one repository by partition pruning; None if it has no nodes."""

    def part(name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(_get(spark, f"{base}/{name}/_schema.json")))
        return spark.read.schema(schema).parquet(f"{base}/{name}").where(F.col("repo_id") == repo_id)

    nodes, edges = part("nodes"), part("edges")
    return None if nodes.isEmpty() else (nodes, edges)


def delete_graph(spark: SparkSession, base: str, repo_id: str) -> None:
    for name in ("nodes", "edges"):
        _delete(spark, f"{base}/{name}/repo_id={repo_id}")


def graph_exists(spark: SparkSession, base: str, repo_id: str) -> bool:
    """Whether the repository has nodes; false where there is no store."""
    return _exists(spark, f"{base}/nodes/repo_id={repo_id}") and read_graph(spark, base, repo_id) is not None


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def document_exists(spark: SparkSession, path: str, key: str) -> bool:
    return _exists(spark, f"{path}/key={key}")


def delete_document(spark: SparkSession, path: str, key: str) -> bool:
    """Whether there was a document under ``key``; it is gone afterwards."""
    return document_exists(spark, path, key) and _delete(spark, f"{path}/key={key}")


def vector_count(spark: SparkSession, path: str, collection: str) -> int:
    """Points of a collection, -1 where there is no such collection, which counts as absent."""
    folder = f"{path}/collection={collection}"
    return spark.read.parquet(folder).count() if _exists(spark, folder) else -1


def needs_index(spark: SparkSession, path: str, collection: str) -> bool:
    """The guard before indexing: nothing is done again for a collection that has points."""
    return vector_count(spark, path, collection) <= 0


def needs_graph(spark: SparkSession, base: str, repo_id: str) -> bool:
    return not graph_exists(spark, base, repo_id)


def write_vectors(vectors: DataFrame, path: str, *, replace: bool = False) -> None:
    """Points by collection. Unless ``replace``, points of equal id in the store are kept apart from new ones by the reader's
    last-wins merge, as a store that appends does."""
    writer = vectors.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("collection").parquet(path)
