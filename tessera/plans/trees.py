"""Folder trees of the pages and checks of generated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normal_title
from tessera.operators import graph, tree, validate
from tessera.plans.graphs import PATHS_SQL, _paths
from tessera.registry import query
from tessera.session import table

_TREE_SQL = f"{PATHS_SQL}, t AS (SELECT prefix AS path, any_value(parent) AS parent, any_value(name) AS name, max(lower(label)) AS type FROM h GROUP BY 1)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(graph.path_prefixes(_paths(spark, sf_dir)))


@query("tree_min_depth", "A22", f"WITH {PATHS_SQL}, g AS (SELECT array_to_string(parts[1:k], '/') AS path, len(parts) - k AS d FROM x WHERE k < len(parts)) SELECT path, min(d)::BIGINT AS min_depth FROM g GROUP BY 1")
def tree_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.min_file_depth(graph.path_prefixes(_paths(spark, sf_dir))).withColumn("min_depth", F.col("min_depth").cast("long"))


@query("folder_counts", "A23 M19", f"WITH {_TREE_SQL} SELECT parent AS path, count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'folder') AS folders FROM t WHERE parent IS NOT NULL GROUP BY 1")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.child_counts(_tree(spark, sf_dir))


@query(
    "tree_groups",
    "T10",
    f'WITH {_TREE_SQL}, g AS (SELECT CASE WHEN contains(path, \'/\') THEN split_part(path, \'/\', 1) ELSE \'(root files)\' END AS "group", path FROM t WHERE type = \'file\') SELECT "group", path, row_number() OVER (PARTITION BY "group" ORDER BY path) AS rank FROM g QUALIFY rank <= 60',
)
def tree_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.root_groups(_tree(spark, sf_dir))


def _folded_sql(levels: int = 8) -> str:
    """The levels of ``_TREE_SQL`` from the deepest up, each with what is below it."""
    head = """concat('{"name":', to_json(name), ',"path":', to_json(t.path), ',"type":', to_json(type), ',"children":[', coalesce(js, ''), ']}')"""
    first = f"d{levels} AS (SELECT NULL::VARCHAR AS path, NULL::VARCHAR AS parent, NULL::VARCHAR AS name, 0::BIGINT AS size, 0::BIGINT AS files, NULL::VARCHAR AS json WHERE false)"
    rest = [
        f"""k{n} AS (SELECT parent AS p, string_agg(json, ',' ORDER BY name) AS js, sum(size) AS s, sum(files) AS f FROM d{n + 1} GROUP BY 1),
    d{n} AS (SELECT t.path, parent, name, (1 + coalesce(s, 0))::BIGINT AS size, (coalesce(f, 0) + CASE WHEN type = 'file' THEN 1 ELSE 0 END)::BIGINT AS files, {head} AS json FROM t LEFT JOIN k{n} ON p = t.path WHERE len(string_split(t.path, '/')) = {n + 1})"""
        for n in range(levels - 1, -1, -1)
    ]
    return ", ".join([_TREE_SQL, first, *rest])


@query("tree_json", "V5 M19", f"WITH {_folded_sql()} SELECT path, size, files, json FROM d0")
def tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree, by what stands in the root."""
    return tree.folded(_tree(spark, sf_dir)).where("depth = 0").select("path", "size", "files", "json")


@query(
    "feature_areas",
    "V5 T10",
    f"""WITH {_TREE_SQL}, g AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root files)' END AS "group", path, name FROM t WHERE type = 'file'),
    r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY path) AS rank FROM g QUALIFY rank <= 60)
    SELECT "group", count(*) AS files, concat('{{"name":', to_json("group"), ',"path":"","type":"component","description":', to_json('Code area: ' || "group"), ',"children":[', string_agg(concat('{{"name":', to_json(name), ',"path":', to_json(path), ',"type":"file","children":[]}}'), ',' ORDER BY rank), ']}}') AS json FROM r GROUP BY 1""",
)
def feature_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.areas(_tree(spark, sf_dir))


@query(
    "tree_descriptions",
    "F25",
    f"""WITH {_TREE_SQL}, c AS (SELECT parent AS path, count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'folder') AS folders FROM t WHERE parent IS NOT NULL GROUP BY 1)
    SELECT path, CASE WHEN type = 'folder' THEN 'Folder ' || name || ' with ' || coalesce(files, 0) || ' files and ' || coalesce(folders, 0) || ' folders' ELSE 'File ' || name END AS description FROM t LEFT JOIN c USING (path)""",
)
def tree_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return t.join(tree.child_counts(t), "path", "left").select("path", tree.description(F.col("type"), F.col("name"), F.col("files"), F.col("folders")).alias("description"))


@query("markdown_render", "F27", "SELECT conv_id AS doc_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role || text) AS text FROM conversations GROUP BY 1")
def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.format_string("%06d.%s%s", "turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), section.alias("section"), F.lit(1).alias("depth"), F.col("role").alias("title"), F.col("text").alias("body"))
    return tree.markdown(rows)


@query("diagram_sections", "P15", "SELECT p_partkey, lower(p_type) NOT IN ('economy', 'overview') AS wanted FROM part")
def diagram_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = normal_title(F.concat(F.lit("  "), "p_type", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", (~title.isin("economy", "overview")).alias("wanted"))


@query(
    "schema_violations",
    "M23 M24 M22",
    """SELECT event_id AS id, unnest(list_filter([CASE WHEN event_id % 5 = 0 THEN 'json' END, CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN 'initial' END, CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 'final' END, CASE WHEN event_id % 5 <> 0 AND event_id % 7 = 0 THEN 'ends' END], lambda x: x IS NOT NULL)) AS rule FROM events""",
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    state = lambda i, kind: F.concat(F.lit(f'{{"id":"{i}","kind":"'), kind, F.lit('"}'))
    body = F.concat(
        F.lit('{"states":['),
        state("a", F.when(e % 2 == 0, "plain").otherwise("initial")),
        F.lit(","),
        state("b", F.when(e % 3 == 0, "plain").otherwise("final")),
        F.lit('],"transitions":[{"source":"a","target":"'),
        F.when(e % 7 == 0, "z").otherwise("b"),
        F.when(e % 5 == 0, '"}').otherwise('"}]}'),
    )
    return validate.violations(table(spark, sf_dir, "events").select(e.alias("id"), body.alias("body")), "state")
