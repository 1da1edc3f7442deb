"""Pull requests: an order is a request, its line items are the changed files and the remarks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pr
from tessera.registry import query
from tessera.session import table


def _s(c: str):
    return F.col(c).cast("string")


_KINDS = ["auth", "docs", "core_config", "main", "util", "schema", "prompt"]


def _request():
    """Requests of one to seven orders, so that their sizes lie around every threshold."""
    k, size = F.col("l_orderkey"), F.floor(F.col("l_orderkey") / 100) % 7
    return (F.floor(k / (size + 1)) * 7 + size).alias("pr_number")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    path = F.concat(kinds[(F.col("l_partkey") % len(_KINDS)).cast("int")], F.lit("/f"), _s("l_suppkey"), F.lit(".py"))
    return table(spark, sf_dir, "lineitem").select(_request(), path.alias("file_path"), (F.col("l_quantity").cast("int") * (F.col("l_partkey") % 4 + 1)).alias("additions"), (F.col("l_linenumber") * 4 * (F.col("l_suppkey") % 5 + 1)).alias("deletions"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    n = F.col("l_suppkey")
    severity = F.when(F.col("l_returnflag") == "R", F.when(n % 11 == 0, "critical").otherwise("high")).when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    kind = F.when(F.col("l_linestatus") == "F", "bug").when(n % 2 == 0, "Style").otherwise("naming")
    said = F.when(n % 5 == 0, "This may break the API").when(n % 5 == 1, "The PR description is short").when(n % 5 == 2, "A performance remark").otherwise("Plain remark")
    why = F.when(n % 7 == 0, "It will break callers").when(n % 7 == 1, "may crash").otherwise("reads badly")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(_request(), F.concat(kinds[(F.col("l_partkey") % len(_KINDS)).cast("int")], F.lit("/x.py")).alias("file"), severity.alias("severity"), kind.alias("type"), said.alias("description"), why.alias("explanation"), "l_orderkey")


_PR = "(l_orderkey // (l_orderkey // 100 % 7 + 1)) * 7 + l_orderkey // 100 % 7"
_SQL = f"""
f AS (SELECT {_PR} AS pr_number, ({_KINDS!r})[l_partkey % {len(_KINDS)} + 1] || '/f' || l_suppkey || '.py' AS file_path, l_quantity::INT * (l_partkey % 4 + 1) AS additions, l_linenumber * 4 * (l_suppkey % 5 + 1) AS deletions FROM lineitem),
i AS (SELECT l_orderkey, {_PR} AS pr_number, ({_KINDS!r})[l_partkey % {len(_KINDS)} + 1] || '/x.py' AS file,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_suppkey % 11 = 0 THEN 'critical' ELSE 'high' END WHEN l_returnflag = 'A' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN l_linestatus = 'F' THEN 'bug' WHEN l_suppkey % 2 = 0 THEN 'Style' ELSE 'naming' END AS type,
  CASE l_suppkey % 5 WHEN 0 THEN 'This may break the API' WHEN 1 THEN 'The PR description is short' WHEN 2 THEN 'A performance remark' ELSE 'Plain remark' END AS description,
  CASE l_suppkey % 7 WHEN 0 THEN 'It will break callers' WHEN 1 THEN 'may crash' ELSE 'reads badly' END AS explanation FROM lineitem),
t AS (SELECT pr_number, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(*) FILTER (regexp_matches(file_path, 'auth|security|database|core|main') AND NOT regexp_matches(file_path, 'schema|config')) AS critical_files, sum(additions + deletions)::BIGINT AS changes FROM f GROUP BY 1),
k AS (SELECT * FROM i WHERE NOT regexp_matches(file, 'schema|config|prompt|template') OR contains(lower(explanation), 'will break') OR contains(lower(description), 'break') OR contains(explanation, 'crash') OR contains(explanation, 'fail') OR severity NOT IN ('critical', 'high')),
c AS (SELECT pr_number, count(*) AS counted, count(*) FILTER (severity = 'critical' AND type = 'bug') AS critical, count(*) FILTER (severity = 'high' AND type = 'bug') AS high, count(*) FILTER (severity = 'high' AND type <> 'bug') AS other_high, count(*) FILTER (severity = 'medium') AS medium FROM k GROUP BY 1),
p AS (SELECT *, (critical > 0)::INT * 30 + (high > 0)::INT * 15 + (other_high > 0)::INT * 8 + (medium > 0)::INT * 3 + (counted > 15)::INT * 3 AS points FROM c),
r AS (SELECT pr_number, files, changes, deletions, CASE WHEN files > 20 THEN 25 WHEN files > 10 THEN 15 WHEN files > 5 THEN 8 ELSE 0 END + CASE WHEN changes > 2000 THEN 25 WHEN changes > 1000 THEN 15 WHEN changes > 500 THEN 8 ELSE 0 END
  + (critical_files > 0)::INT * 20 + CASE WHEN deletions > 500 THEN 20 WHEN deletions > 200 THEN 10 ELSE 0 END + coalesce(points, 0) AS raw FROM t LEFT JOIN p USING (pr_number))
"""


@query("pr_size_points", "A14 P12", f"WITH {_SQL} SELECT * FROM t")
def pr_size_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.size_totals(_files(spark, sf_dir))


@query(
    "pr_risk",
    "A15 P11 P12 K23 K24 K29",
    f"WITH {_SQL} SELECT pr_number, files, changes, deletions, least(raw, 100)::BIGINT AS score, CASE WHEN raw >= 70 THEN 'critical' WHEN raw >= 50 THEN 'very high' WHEN raw >= 30 THEN 'high' WHEN raw >= 15 THEN 'medium' ELSE 'low' END AS level FROM r",
)
def pr_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.risk(_files(spark, sf_dir), _issues(spark, sf_dir)).select("pr_number", "files", "changes", "deletions", "score", "level")


_FACTORS = """[CASE WHEN files > 20 THEN 'Very large number of files changed (' || files || ')' WHEN files > 10 THEN 'Large number of files changed (' || files || ')' WHEN files > 5 THEN 'Multiple files changed (' || files || ')' END,
  CASE WHEN changes > 2000 THEN 'Very large changes (' || changes || ' lines)' WHEN changes > 1000 THEN 'Large changes (' || changes || ' lines)' WHEN changes > 500 THEN 'Moderate changes (' || changes || ' lines)' END,
  CASE WHEN critical_files > 0 THEN 'Critical infrastructure files modified (' || critical_files || ')' END,
  CASE WHEN deletions > 500 THEN 'Very significant deletions (' || deletions || ' lines)' WHEN deletions > 200 THEN 'Significant deletions (' || deletions || ' lines)' END,
  CASE WHEN critical > 0 THEN critical || ' critical breaking issue(s) detected' END, CASE WHEN high > 0 THEN high || ' high-severity breaking issue(s) detected' END,
  CASE WHEN other_high > 0 THEN other_high || ' high-severity issue(s) detected' END, CASE WHEN medium > 0 THEN medium || ' medium-severity issue(s) detected' END,
  CASE WHEN counted > 15 THEN 'Many issues detected (' || counted || ' total)' END]"""


@query(
    "pr_risk_words",
    "A15 T12",
    f"""WITH {_SQL}, j AS (SELECT t.*, raw, coalesce(counted, 0) AS counted, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(other_high, 0) AS other_high, coalesce(medium, 0) AS medium FROM t JOIN r USING (pr_number) LEFT JOIN p USING (pr_number)),
    w AS (SELECT pr_number, raw, list_filter({_FACTORS}, lambda x: x IS NOT NULL) AS factors FROM j)
    SELECT pr_number, array_to_string(factors, '; ') AS factors, CASE WHEN raw >= 70 THEN 'This PR contains changes that may break the codebase. ' WHEN raw >= 50 THEN 'This PR has significant changes that require careful review. ' WHEN raw >= 30 THEN 'This PR has notable changes that should be reviewed. '
      WHEN raw >= 15 THEN 'This PR has moderate changes. ' ELSE 'This PR appears to be low risk. ' END || CASE WHEN len(factors) > 0 THEN 'Consider: ' || array_to_string(factors[1:2], '; ') WHEN raw < 30 THEN 'Changes appear safe to merge.' ELSE 'Review recommended before merging.' END AS explanation FROM w""",
)
def pr_risk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.risk(_files(spark, sf_dir), _issues(spark, sf_dir)).select("pr_number", "factors", "explanation")


@query("pr_issue_points", "A15 P11 K24", f"WITH {_SQL} SELECT pr_number, counted, critical, high, other_high, medium, points::BIGINT AS points FROM p")
def pr_issue_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.issue_points(_issues(spark, sf_dir)).withColumn("points", F.col("points").cast("long"))


@query("pr_severities", "A16", f"WITH {_SQL} SELECT pr_number, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM i GROUP BY 1")
def pr_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.severity_counts(_issues(spark, sf_dir))


@query(
    "pr_issue_filter",
    "P10",
    f"""WITH {_SQL} SELECT l_orderkey, severity, type FROM i WHERE NOT contains(lower(description), 'pr description') AND NOT contains(lower(description), 'description is')
    AND NOT (severity = 'low' AND lower(type) IN ('style', 'formatting', 'naming') AND NOT regexp_matches(lower(description), 'security|performance|bug|error|crash|breaking'))""",
)
def pr_issue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).where(~pr.is_noise(F.col("type"), F.col("severity"), F.col("description"))).select("l_orderkey", "severity", "type")


_PATCH = """
o AS (SELECT c_custkey AS k, ['@@ -1,3 +' || (c_custkey % 9 + 1) || ',4 @@ head', ' ' || c_name, '-old', '+new ' || c_mktsegment, '+more', ' end', '@@ -40 +' || (50 + c_custkey % 5) || ' @@', '+last', '\\ No newline at end of file'] AS ls FROM customer),
l AS (SELECT k, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM o),
h AS (SELECT *, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS hunk FROM l),
g AS (SELECT *, left(line, 1) AS sign, max(CASE WHEN starts_with(line, '@@') THEN regexp_extract(line, '\\+([0-9]+)', 1)::INT END) OVER (PARTITION BY k, hunk) AS s FROM h),
n AS (SELECT *, CASE WHEN sign IN ('+', ' ') THEN s - 1 + sum(CASE WHEN sign IN ('+', ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY k, hunk ORDER BY pos) END AS new_line FROM g)
"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lines = [
        F.concat(F.lit("@@ -1,3 +"), (k % 9 + 1).cast("string"), F.lit(",4 @@ head")),
        F.concat(F.lit(" "), "c_name"),
        F.lit("-old"),
        F.concat(F.lit("+new "), "c_mktsegment"),
        F.lit("+more"),
        F.lit(" end"),
        F.concat(F.lit("@@ -40 +"), (k % 5 + 50).cast("string"), F.lit(" @@")),
        F.lit("+last"),
        F.lit("\\ No newline at end of file"),
    ]
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.concat_ws("\n", *lines).alias("patch"))


@query("diff_line_index", "F21", f"WITH {_PATCH} SELECT k, pos::BIGINT AS pos, hunk::BIGINT AS hunk, sign, new_line::BIGINT AS new_line, line[2:] AS text FROM n WHERE sign <> '@'")
def diff_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.diff_lines(_patches(spark, sf_dir), "k")
    return rows.select("k", *[F.col(c).cast("long").alias(c) for c in ("pos", "hunk")], "sign", F.col("new_line").cast("long").alias("new_line"), "text")


#: Patches with file headers, blank lines, removals that look like headers, hunks longer than they say, and none at all.
_TARGETS = """
o AS (SELECT c_custkey AS k, (c_custkey % 71)::INT AS target, CASE c_custkey % 10 WHEN 0 THEN ['no hunk here'] WHEN 1 THEN ['diff --git a/x b/x', '@@ nothing @@', '   '] ELSE
  list_concat(['diff --git a/x b/x', 'index 1..2', '--- a/x', '+++ b/x', '@@ -1,3 +' || (c_custkey % 9 + 1) || ',4 @@ head', ' ' || c_name, '-old', '---- old rule', '', '+new ' || c_mktsegment, '  ', '++++more', ' end'],
    list_concat(list_transform(range(0, c_custkey % 30), lambda i: '+line ' || i), ['@@ -40 +' || (50 + c_custkey % 5) || ' @@', '+last', '\\ No newline at end of file'])) END AS ls FROM customer),
l AS (SELECT k, target, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM o),
b AS (SELECT *, trim(line) AS bare, starts_with(line, '@@') AS head, regexp_extract(line, '\\+([0-9]+)(?:,([0-9]+))?', 1) AS s1, regexp_extract(line, '\\+([0-9]+)(?:,([0-9]+))?', 2) AS s2, regexp_matches(line, '^(diff --git|index |--- a/|[+]{3} b/)') AS file FROM l),
h AS (SELECT *, sum(CASE WHEN head AND s1 <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS hunk, NOT head AND NOT file AND line <> '' AND NOT starts_with(line, chr(92)) AND (NOT starts_with(line, '-') OR starts_with(line, '---')) AS counts FROM b),
g AS (SELECT *, max(CASE WHEN head AND s1 <> '' THEN s1::INT END) OVER (PARTITION BY k, hunk) AS s, max(CASE WHEN head AND s1 <> '' THEN CASE WHEN s2 = '' THEN 0 ELSE s2::INT END END) OVER (PARTITION BY k, hunk) AS c FROM h),
n AS (SELECT *, s - 1 + sum(CASE WHEN counts THEN 1 ELSE 0 END) OVER (PARTITION BY k, hunk ORDER BY pos) AS number FROM g),
found AS (SELECT k, min(pos) FILTER (hunk > 0 AND counts AND target BETWEEN s AND s + c + 20 AND number = target) AS hit, min(pos) FILTER (head) AS first FROM n GROUP BY k),
p AS (SELECT k, pos, line, 1 AS way FROM n JOIN found USING (k) WHERE pos BETWEEN hit - 5 AND hit + 5 AND bare <> '' AND NOT regexp_matches(bare, '^(diff --git|index |--- a/|[+]{3} b/|@@)')
  UNION ALL SELECT k, pos, line, 2 FROM n JOIN found USING (k) WHERE pos BETWEEN first - 2 AND first + 14 AND bare <> '' AND NOT regexp_matches(bare, '^(diff --git|index |--- a/|[+]{3} b/)')),
t AS (SELECT k, way, string_agg(line, chr(10) ORDER BY pos) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY k, way ORDER BY pos) AS r FROM p) WHERE r <= CASE way WHEN 1 THEN 25 ELSE 20 END GROUP BY k, way)
"""


@query("diff_snippets", "F21", f"WITH {_TARGETS} SELECT o.k, o.target, coalesce(min_by(snippet, way), '') AS snippet FROM o LEFT JOIN t ON t.k = o.k GROUP BY 1, 2")
def diff_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    hunk = F.array(*[F.lit(x) for x in ("diff --git a/x b/x", "index 1..2", "--- a/x", "+++ b/x")], F.concat(F.lit("@@ -1,3 +"), (k % 9 + 1).cast("string"), F.lit(",4 @@ head")), F.concat(F.lit(" "), "c_name"), F.lit("-old"), F.lit("---- old rule"), F.lit(""), F.concat(F.lit("+new "), "c_mktsegment"), F.lit("  "), F.lit("++++more"), F.lit(" end"))
    more = F.filter(F.transform(F.sequence(F.lit(0), k % 30), lambda i: F.when(i < k % 30, F.concat(F.lit("+line "), i.cast("string")))), lambda x: x.isNotNull())
    last = F.array(F.concat(F.lit("@@ -40 +"), (k % 5 + 50).cast("string"), F.lit(" @@")), F.lit("+last"), F.lit("\\ No newline at end of file"))
    lines = F.when(k % 10 == 0, F.array(F.lit("no hunk here"))).when(k % 10 == 1, F.array(F.lit("diff --git a/x b/x"), F.lit("@@ nothing @@"), F.lit("   "))).otherwise(F.concat(hunk, more, last))
    patches = table(spark, sf_dir, "customer").select(k.alias("k"), F.array_join(lines, "\n").alias("patch"))
    return pr.diff_snippet(patches, table(spark, sf_dir, "customer").select(k.alias("k"), (k % 71).cast("int").alias("target")), "k")
