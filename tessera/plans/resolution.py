"""Calls, imports, chunks and references: parts define, line items call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunks, resolve
from tessera.registry import query
from tessera.session import table


def _s(c: str):
    return F.col(c).cast("string")


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("f"), _s("p_size"), F.lit(".py")).alias("path"), F.col("p_partkey").alias("ordinal"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    li = table(spark, sf_dir, "lineitem").join(named, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("lib_"), "p_name")).otherwise(F.col("p_name"))
    return li.select(name.alias("function_name"), F.concat(F.lit("f"), (F.col("l_suppkey") % 50 + 1).cast("string"), F.lit(".py")).alias("path"))


_CALLS = """
d AS (SELECT p_name AS name, max_by('f' || p_size || '.py', p_partkey) AS path FROM part GROUP BY 1),
c AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'lib_' || p_name ELSE p_name END AS function_name, 'f' || (l_suppkey % 50 + 1) || '.py' AS path FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


@query("call_resolution", "J2 U2 M8", f"WITH {_CALLS} SELECT c.path AS from_path, d.path AS to_path, 'call' AS type, function_name AS relationship, count(*) AS n FROM c JOIN d ON function_name = name WHERE c.path <> d.path GROUP BY ALL")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.call_dependencies(_calls(spark, sf_dir), _definitions(spark, sf_dir))
    return found.groupBy("from_path", "to_path", "type", "relationship").agg(F.count(F.lit(1)).alias("n"))


@query("usage_rollup", "J3 A11 J7 M10", f"WITH {_CALLS}, u AS (SELECT function_name AS name, count(*) AS n FROM c GROUP BY 1) SELECT coalesce(d.name, u.name) AS name, d.path AS defined_in, coalesce(n, 0) AS total_calls FROM d FULL JOIN u ON d.name = u.name")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.usage(_calls(spark, sf_dir), _definitions(spark, sf_dir))


_SPANS = """
f AS (SELECT o_custkey AS path, (o_orderkey % 40)::INT AS s, (o_orderkey % 40 + o_orderkey % 25)::INT AS e, 'fn' || o_orderkey AS name FROM orders),
c AS (SELECT DISTINCT o_custkey AS path, (l_orderkey * 7 + l_linenumber) % 60 AS line, l_linenumber AS col FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    functions = o.select(F.col("o_custkey").alias("path"), (k % 40).cast("int").alias("start_line"), (k % 40 + k % 25).cast("int").alias("end_line"), F.concat(F.lit("fn"), k.cast("string")).alias("name"))
    sites = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == k).select(F.col("o_custkey").alias("path"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 60).alias("line"), F.col("l_linenumber").alias("col"))
    return sites.distinct(), functions


@query("containment_context", "J5 J5b J6 K3 K4", f"WITH {_SPANS} SELECT c.path, c.line, c.col, min_by(name, (s, -e, name)) AS context FROM c LEFT JOIN f ON c.path = f.path AND line BETWEEN s AND e GROUP BY 1, 2, 3")
def containment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.containing(*_spans(spark, sf_dir))


@query("containment_innermost", "J5 K4", f"WITH {_SPANS} SELECT c.path, c.line, c.col, max_by(name, (s, -e, name)) AS context FROM c LEFT JOIN f ON c.path = f.path AND line BETWEEN s AND e GROUP BY 1, 2, 3")
def containment_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.containing(*_spans(spark, sf_dir), innermost=True)


@query(
    "relative_path_resolution",
    "J4 K7 K8",
    """WITH f AS (SELECT 'src/d' || (p_partkey % 20) || '/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.ts' END AS path, p_partkey AS o FROM part),
    i AS (SELECT 'src/d' || (p_partkey % 20) || '/x' || p_partkey || '.ts' AS from_path, '../d' || ((p_partkey + 1) % 20) || '/m' || (p_partkey + 1) AS source, 'src/d' || ((p_partkey + 1) % 20) || '/m' || (p_partkey + 1) AS base FROM part),
    t AS (SELECT i.*, unnest([{'r': 0, 'e': ''}, {'r': 1, 'e': '.ts'}, {'r': 2, 'e': '.tsx'}, {'r': 3, 'e': '.js'}, {'r': 4, 'e': '.jsx'}, {'r': 5, 'e': '/index.ts'}, {'r': 6, 'e': '/index.tsx'}]) AS x FROM i),
    h AS (SELECT from_path, source, path, o, 2 * x.r + CASE WHEN path = base || x.e THEN 0 ELSE 1 END AS k FROM t JOIN f ON path = base || x.e OR starts_with(path, regexp_replace(base || x.e, '\\.(tsx?|jsx?)$', ''))),
    b AS (SELECT from_path, source, min_by(path, (k, o)) AS to_path FROM h GROUP BY 1, 2)
    SELECT DISTINCT i.from_path, i.source, to_path FROM i LEFT JOIN b USING (from_path, source)""",
)
def relative_path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    end = F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.ts")
    place = lambda key: F.concat(F.lit("d"), (key % 20).cast("string"), F.lit("/"))
    files = p.select(F.concat(F.lit("src/"), place(k), F.lit("m"), k.cast("string"), end).alias("path"), k.alias("ordinal"))
    imports = p.select(F.concat(F.lit("src/"), place(k), F.lit("x"), k.cast("string"), F.lit(".ts")).alias("from_path"), F.concat(F.lit("../"), place(k + 1), F.lit("m"), (k + 1).cast("string")).alias("source"))
    return resolve.resolve_imports(imports, files)


_CHUNKS = """
k AS (SELECT l_orderkey || ':' || l_linenumber AS id, 'f' || l_partkey AS fn, 'p' || l_orderkey AS file, ['f' || l_orderkey // 2] AS calls, ['p' || l_partkey] AS deps, ['p' || l_orderkey || ':f' || l_partkey] AS callers FROM lineitem)
"""


@query(
    "related_chunks",
    "J9 J9b J8 K13",
    f"""WITH {_CHUNKS}, r AS (SELECT a.id, b.id AS related FROM k a JOIN k b ON a.calls[1] = b.fn UNION SELECT a.id, b.id FROM k a JOIN k b ON a.deps[1] = b.file
    UNION SELECT a.id, b.id FROM k a JOIN k b ON a.callers[1] = b.file || ':' || b.fn) SELECT id, count(*) AS related, min(related) AS first, max(related) AS last FROM r GROUP BY 1""",
)
def related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda letter, value: F.concat(F.lit(letter), value.cast("string"))
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    k = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", _s("l_orderkey"), _s("l_linenumber")).alias("id"),
        named("f", part).alias("function_name"),
        named("p", order).alias("file_path"),
        F.array(named("f", F.floor(order / 2))).alias("calls"),
        F.array(named("p", part)).alias("dependencies"),
        F.array(F.concat(named("p", order), F.lit(":"), named("f", part))).alias("called_by"),
    )
    return resolve.related_chunks(k).groupBy("id").agg(F.count(F.lit(1)).alias("related"), F.min("related").alias("first"), F.max("related").alias("last"))


@query(
    "symbol_usage_top10",
    "J11",
    """WITH s AS (SELECT item_id, text AS name FROM benchmark), h AS (SELECT item_id, name, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS k FROM s JOIN documents ON contains(text, name))
    SELECT item_id, doc_id, k AS rank FROM h WHERE k <= 10""",
)
def symbol_usage_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "benchmark").select(F.col("text").alias("name"), F.concat(F.lit("b"), _s("item_id")).alias("path"))
    d = table(spark, sf_dir, "documents").select(_s("doc_id").alias("path"), F.col("doc_id").alias("ordinal"), F.col("text").alias("content"))
    used = resolve.symbol_uses(s, d)
    return used.select(F.expr("substring(own_path, 2)").cast("long").alias("item_id"), F.col("path").cast("long").alias("doc_id"), "rank")


@query(
    "ref_resolution",
    "J13 K22",
    """WITH c AS (SELECT p_partkey AS id, p_partkey AS k, replace(p_name, ' ', '_') AS fn, p_brand AS cls FROM part), n AS (SELECT lower(replace(fn, '_', '')) AS key, id, k, 0 AS kind FROM c UNION ALL SELECT lower(replace(cls, '_', '')), id, k, 1 FROM c),
    b AS (SELECT key, min_by(id, (k, kind)) AS chunk_id FROM n GROUP BY 1), r AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS ref FROM part UNION SELECT DISTINCT p_brand || '_' FROM part UNION SELECT 'none')
    SELECT ref, chunk_id FROM r LEFT JOIN b ON lower(replace(ref, '_', '')) = key""",
)
def ref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("chunk_rank"), F.regexp_replace("p_name", " ", "_").alias("function_name"), F.col("p_brand").alias("class_name"), F.lit(None).cast("string").alias("method_name"))
    refs = p.select(F.upper(F.regexp_replace("p_name", " ", "")).alias("ref")).union(p.select(F.concat("p_brand", F.lit("_")))).union(spark.range(1).select(F.lit("none"))).distinct()
    return resolve.resolve_references(refs, c)


@query(
    "ref_unmatched",
    "J14",
    """WITH b AS (SELECT item_id, split_part(text, chr(10), 1) AS t, text FROM benchmark),
    r AS (SELECT t AS ref FROM b UNION SELECT left(t, 3) || '_' || t[4:] FROM b UNION SELECT replace(t, 'e', 'E') FROM b UNION SELECT text FROM b UNION SELECT '_' || split_part(t, ' ', 2) FROM b),
    f AS (SELECT ref, min(doc_id) AS chunk_id FROM r JOIN documents ON NOT contains(ref, chr(10)) AND (contains(text, ref) OR replace(ref, '_', '') <> '' AND contains(replace(text, '_', ''), replace(ref, '_', ''))) GROUP BY 1),
    l AS (SELECT ref, chunk_id, string_split(text, chr(10)) AS ls FROM f JOIN documents ON doc_id = chunk_id),
    n AS (SELECT *, list_position(list_transform(ls, lambda x: contains(x, ref) OR replace(ref, '_', '') <> '' AND contains(replace(x, '_', ''), replace(ref, '_', ''))), true) AS i FROM l)
    SELECT ref, chunk_id, array_to_string(ls[greatest(1, i - 5):i + 5], chr(10)) AS context FROM r LEFT JOIN n USING (ref)""",
)
def ref_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they stand in a text, with an underscore more, in other case, and over several lines."""
    t = F.substring_index("text", "\n", 1)
    forms = [t, F.concat(F.substring(t, 1, 3), F.lit("_"), t.substr(F.lit(4), F.length(t))), F.regexp_replace(t, "e", "E"), F.col("text"), F.concat(F.lit("_"), F.split_part(t, F.lit(" "), F.lit(2)))]
    refs = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*forms)).alias("ref"), F.lit(None).cast("string").alias("chunk_id"))
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_rank"), F.col("text").alias("content"))
    return resolve.unmatched_references(refs, c)


@query(
    "hybrid_override",
    "J10 U3 C4 K12",
    """WITH f AS (SELECT 'c' || p_partkey % 300 AS id, 'function' AS type, p_name AS content, p_partkey AS o FROM part), g AS (SELECT 'flow:' || s_suppkey AS id, 'flow' AS type, s_name AS content, 'c' || s_suppkey % 300 AS member FROM supplier),
    k AS (SELECT * FROM f WHERE id NOT IN (SELECT member FROM g)) SELECT id, max_by(type, o) AS type, max_by(content, o) AS content FROM k GROUP BY 1 UNION ALL SELECT id, type, content FROM g""",
)
def hybrid_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("c"), (F.col(c) % 300).cast("string"))
    f = table(spark, sf_dir, "part").select(key("p_partkey").alias("id"), F.lit("function").alias("type"), F.col("p_name").alias("content"), F.col("p_partkey").alias("ordinal"))
    g = table(spark, sf_dir, "supplier").select(F.concat(F.lit("flow:"), _s("s_suppkey")).alias("id"), F.lit("flow").alias("type"), F.col("s_name").alias("content"), F.array(key("s_suppkey")).alias("members"))
    return chunks.hybrid(f, g).select("id", "type", "content")
