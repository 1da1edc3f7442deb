"""From source files to symbols, chunks and graphs: every part is a Python file, every supplier a TypeScript file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import cleaned_comment, embedding_text
from tessera.operators import analysis, summaries
from tessera.operators.extract import generated, scan
from tessera.operators.extract.python_source import without_docstrings
from tessera.registry import query
from tessera.session import table

_PY = """import os
from .m{next} import f{next}, g

class C{k}(Base{base}):
    def run{k}(self, a, b: int = {size}):
        return f{next}(a)

    async def wait(self):
        pass

def f{k}(x: str) -> str:
    \"\"\"Adds what part number {k} stands for.\"\"\"
    helper(x)
    return C{k}().run{k}(x)
"""
_TS = """import {{ h }} from "./s{next}";
export const cfg{k} = {{ port: {k} }};
export async function load{k}(x: number, y = 2): number {{
  return h(x);
}}
export class Box{k} extends Base {{
  size = 1;
  static make(n: number) {{ return new Box{k}(); }}
}}
app.get("/r{k}", (req) => {{ load{k}(req); }});
export default load{k};
"""


def _filled(template: str, values: dict[str, Column]) -> Column:
    """``template`` with the fields in braces taken from ``values``, as one concatenation."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        if rest.startswith("{"):
            parts.append(F.lit(before + "{"))
            rest = rest[1:]
            continue
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.regexp_replace(F.concat(*parts, F.lit(rest)), r"\}\}", "}")


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, ordinal, repo_id): every tenth file cannot be parsed."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/d"), (k % 7).cast("string"), F.lit("/m"), k.cast("string"), F.lit(".py"))
    text = _filled(_PY, {"k": k, "next": k + 1, "base": k % 5, "size": F.col("p_size")})
    return table(spark, sf_dir, "part").select(path.alias("path"), F.when(k % 10 == 0, "def (\n").otherwise(text).alias("content"), k.alias("ordinal"), F.lit("r").alias("repo_id"), F.lit("python").alias("language"))


def _script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(F.lit("web/d"), (k % 7).cast("string"), F.lit("/s"), k.cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "supplier").select(path.alias("path"), _filled(_TS, {"k": k, "next": k + 1}).alias("content"), k.alias("ordinal"))


_FILES = """
p AS (SELECT p_partkey AS k, p_partkey + 1 AS nx, p_size, 'src/d' || p_partkey % 7 || '/m' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 10 <> 0),
b AS (SELECT p_partkey AS k, 'src/d' || p_partkey % 7 || '/m' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 10 = 0),
t AS (SELECT s_suppkey AS k, s_suppkey + 1 AS nx, 'web/d' || s_suppkey % 7 || '/s' || s_suppkey || '.ts' AS path FROM supplier)
"""
_FUNCTIONS = """SELECT path, 'run' || k AS name, 5 AS start_line, 6 AS end_line, false AS is_async, NULL::VARCHAR AS return_type FROM p
UNION ALL SELECT path, 'wait', 8, 9, true, NULL FROM p UNION ALL SELECT path, 'f' || k, 11, 14, false, 'str' FROM p"""


@query("extract_functions", "X1 X3 X9 P4", f"WITH {_FILES} {_FUNCTIONS}")
def extract_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.symbols(scan.found(_python_files(spark, sf_dir), "symbol")).where("kind = 'function'")
    return rows.select("path", "name", "start_line", "end_line", "is_async", "return_type")


@query("extract_classes", "X4", f"WITH {_FILES} SELECT path, 'class' AS kind, 'C' || k AS name, NULL::VARCHAR AS parent, 4 AS start_line, 9 AS end_line, 'Base' || k % 5 AS extends FROM p UNION ALL SELECT path, 'method', 'run' || k, 'C' || k, 5, 6, NULL FROM p UNION ALL SELECT path, 'method', 'wait', 'C' || k, 8, 9, NULL FROM p")
def extract_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.symbols(scan.found(_python_files(spark, sf_dir), "symbol")).where("kind in ('class', 'method')")
    return rows.select("path", "kind", "name", "parent", "start_line", "end_line", "extends")


@query("extract_parameters", "X9", f"WITH {_FILES} SELECT path, 'run' || k AS name, 'self,a,b: int = ' || p_size AS parameters FROM p UNION ALL SELECT path, 'wait', 'self' FROM p UNION ALL SELECT path, 'f' || k, 'x: str' FROM p UNION ALL SELECT path, 'load' || k, 'x: number,y = 2' FROM t")
def extract_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _python_files(spark, sf_dir).select("path", "content").unionByName(_script_files(spark, sf_dir).select("path", "content"))
    rows = scan.symbols(scan.found(files, "symbol")).where("kind = 'function' and name is not null")
    shown = F.transform("parameters", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")), F.coalesce(F.concat(F.lit(" = "), p["default_value"]), F.lit(""))))
    return rows.select("path", "name", F.array_join(shown, ",").alias("parameters"))


@query("extract_imports", "X10", f"WITH {_FILES} SELECT path, 'os' AS source, 'os' AS imports FROM p UNION ALL SELECT path, '.m' || nx, 'f' || nx || ',g' FROM p UNION ALL SELECT path, './s' || nx, 'h' FROM t")
def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _python_files(spark, sf_dir).select("path", "content").unionByName(_script_files(spark, sf_dir).select("path", "content"))
    return scan.imports(scan.found(files, "import")).select(F.col("from_path").alias("path"), "source", F.array_join("imports", ",").alias("imports"))


@query("extract_inheritance", "X11", f"WITH {_FILES} SELECT path AS from_path, 'Base' || k % 5 AS to_path, 'extends' AS type, 'C' || k AS relationship FROM p UNION ALL SELECT path, 'Base', 'extends', 'Box' || k FROM t")
def extract_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _python_files(spark, sf_dir).select("path", "content").unionByName(_script_files(spark, sf_dir).select("path", "content"))
    return scan.inheritance(scan.found(files, "inheritance"))


@query("extract_calls", "X12", f"WITH {_FILES} SELECT path, 'f' || nx AS function_name, 6 AS line, 'function' AS call_type FROM p UNION ALL SELECT path, 'helper', 13, 'function' FROM p UNION ALL SELECT path, 'run' || k, 14, 'method' FROM p UNION ALL SELECT path, 'C' || k, 14, 'constructor' FROM p")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.calls(scan.found(_python_files(spark, sf_dir), "call")).select("path", "function_name", "line", "call_type")


@query("extract_errors", "X1 X2", f"WITH {_FILES} SELECT path, 'SyntaxError' AS kind, 0 AS symbols FROM b")
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be parsed give an error and nothing else; the others are not kept from being read."""
    found = scan.found(_python_files(spark, sf_dir), "symbol").where("what in ('error', 'symbol')")
    by_file = found.groupBy("path").agg(F.collect_list(F.when(F.col("what") == "error", F.col("kind"))).alias("kinds"), F.count_if(F.col("what") == "symbol").cast("int").alias("symbols"))
    return by_file.select("path", F.explode("kinds").alias("kind"), "symbols")


@query(
    "extract_script_symbols",
    "X5 X6 X7 X8 X4",
    f"""WITH {_FILES} SELECT path, 'constant' AS kind, 'cfg' || k AS name, 2 AS start_line, NULL::VARCHAR AS source FROM t UNION ALL SELECT path, 'route', 'GET', 10, '/r' || k FROM t
    UNION ALL SELECT path, 'default_export', 'load' || k, 11, NULL FROM t UNION ALL SELECT path, 'class', 'Box' || k, 6, NULL FROM t UNION ALL SELECT path, 'method', 'make', 8, NULL FROM t UNION ALL SELECT path, 'property', 'size', 7, NULL FROM t""",
)
def extract_script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.symbols(scan.found(_script_files(spark, sf_dir), "symbol")).where("kind != 'function'")
    return rows.select("path", "kind", "name", "start_line", "source")


@query("extract_exports", "X6", f"WITH {_FILES} SELECT path, 'load' || k AS name FROM t UNION ALL SELECT path, 'Box' || k FROM t UNION ALL SELECT path, 'cfg' || k FROM t")
def extract_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names exported where they are declared."""
    return scan.symbols(scan.found(_script_files(spark, sf_dir), "symbol")).where("is_exported and kind in ('function', 'class', 'constant')").select("path", "name")


def _analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    files = _python_files(spark, sf_dir)
    return files, analysis.analyze(files, "function")


@query(
    "function_chunks",
    "C1 C2 C5",
    f"""WITH {_FILES} SELECT path || ':C' || k AS id, 'class' AS type, 6 AS lines FROM p UNION ALL SELECT path || ':C' || k || '.run' || k, 'method', 2 FROM p UNION ALL SELECT path || ':C' || k || '.wait', 'method', 2 FROM p
    UNION ALL SELECT path || ':run' || k, 'function', 2 FROM p UNION ALL SELECT path || ':wait', 'function', 2 FROM p UNION ALL SELECT path || ':f' || k, 'function', 4 FROM p UNION ALL SELECT path || ':file', 'file', 2 FROM b""",
)
def function_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _analysed(spark, sf_dir)[1]["chunks"]
    return made.select("id", "type", F.size(F.split("content", "\n", -1)).alias("lines"))


#: Families of six functions in a file each: every one calls one of its own, some a second, and some families the next one.
_FAMILIES = """
fam AS (SELECT DISTINCT p_partkey // 6 AS f FROM part), fn AS (
  SELECT f, j, (f - j % 6 + 6) % 6 AS pos, 'flow/d' || f % 7 || '/m' || f || '.py' AS path, 'fn' || f || '_' || j AS name FROM fam, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS j)
), called AS (
  SELECT f, j, 1 AS n, 'fn' || f || '_' || (j * (f % 5 + 1) + 1) % 6 AS name FROM fn UNION ALL SELECT f, j, 2, 'fn' || f || '_' || (j + f) % 6 FROM fn WHERE (j + f) % 3 = 0
  UNION ALL SELECT f, j, 3, 'fn' || f + 1 || '_2' FROM fn WHERE f % 4 = 0 AND j = 3
), body AS (SELECT f, j, 'def fn' || f || '_' || j || '():' || string_agg(chr(10) || '    ' || name || '()', '' ORDER BY n) AS code FROM called GROUP BY f, j),
node AS (SELECT path || ':' || fn.name AS id, path, fn.name, f * 6 + pos AS place, code FROM fn JOIN body USING (f, j)),
edge AS (SELECT DISTINCT fn.path || ':' || fn.name AS s, t.id AS t, t.place FROM called JOIN fn USING (f, j) JOIN node t ON t.name = called.name)
"""


def _family_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, ordinal, repo_id): the files of ``_FAMILIES``."""
    f = F.col("f")
    families = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 6).alias("f")).distinct()

    def function(i: int) -> Column:
        j = (5 * i + f) % 6
        name = lambda family, k: F.concat(F.lit("fn"), family.cast("string"), F.lit("_"), k.cast("string"))
        call = lambda n: F.concat(F.lit("\n    "), n, F.lit("()"))
        second = F.when((j + f) % 3 == 0, call(name(f, (j + f) % 6))).otherwise("")
        third = F.when((f % 4 == 0) & (j == 3), call(name(f + 1, F.lit(2)))).otherwise("")
        return F.concat(F.lit("def "), name(f, j), F.lit("():"), call(name(f, (j * (f % 5 + 1) + 1) % 6)), second, third)

    path = F.concat(F.lit("flow/d"), (f % 7).cast("string"), F.lit("/m"), f.cast("string"), F.lit(".py"))
    return families.select(path.alias("path"), F.concat_ws("\n\n", *[function(i) for i in range(6)]).alias("content"), f.alias("ordinal"), F.lit("r").alias("repo_id"))


@query(
    "flow_chunks",
    "C1 C3 G3",
    f"""WITH RECURSIVE {_FAMILIES}, walk AS (
      SELECT id AS start, id AS node, 0 AS d, [place] AS k, [id] AS seen FROM node
      UNION ALL SELECT start, t, d + 1, list_append(k, edge.place), list_append(seen, t) FROM walk JOIN edge ON s = node WHERE NOT list_contains(seen, t)
    ), best AS (SELECT start, node, min({{'d': d, 'k': k}}) AS o FROM walk GROUP BY 1, 2),
    late AS (SELECT DISTINCT b.node FROM best b JOIN node x ON x.id = b.start JOIN node y ON y.id = b.node WHERE x.place < y.place),
    chain AS (SELECT start, count(*) AS n, string_agg(node, ',' ORDER BY o) AS members, string_agg('// ' || path || ':' || name || chr(10) || code, chr(10) || chr(10) ORDER BY o) AS text, min(code) AS code FROM best JOIN node ON id = node WHERE start NOT IN (SELECT node FROM late) GROUP BY 1)
    SELECT CASE WHEN n = 1 THEN start ELSE 'flow:' || start END AS id, CASE WHEN n = 1 THEN 'function' ELSE 'flow' END AS type, members, CASE WHEN n = 1 THEN code ELSE text END AS content FROM chain""",
)
def flow_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, cycles and chains that several functions share, from the files to the chunks."""
    made = analysis.analyze(_family_files(spark, sf_dir), "flow")["chunks"]
    return made.select("id", "type", F.array_join("members", ",").alias("members"), "content")


@query("analysis_counters", "A10 C6", f"WITH {_FILES} SELECT (SELECT count(*) FROM part) AS files, 6 * count(*) + (SELECT count(*) FROM b) AS chunks, (SELECT count(*) FROM b) AS errors, 3 * count(*) AS \"function\", count(*) AS class, 0::BIGINT AS constant, 2 * count(*) AS method, 0::BIGINT AS route, 0::BIGINT AS default_export FROM p")
def analysis_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _analysed(spark, sf_dir)
    return summaries.counters(files, found["symbols"], found["chunks"], found["errors"])


@query("symbol_summaries", "P20", f"WITH {_FILES} SELECT path, 'run' || k || ',wait,f' || k AS functions, 'run' || k || ':3,wait:1' AS methods, length('    def run' || k || '(self, a, b: int = ' || p_size || '):' || chr(10) || '        return f' || nx || '(a)') AS snippet FROM p")
def symbol_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries.symbol_summary(scan.symbols(scan.found(_python_files(spark, sf_dir), "symbol")))
    by_line = F.array_sort(F.transform("functions", lambda f: F.struct(f["start_line"].alias("l"), f["name"].alias("n"), f["snippet"].alias("s"))))
    methods = F.transform(F.col("classes")[0]["methods"], lambda m: F.concat_ws(":", m["name"], m["parameters"].cast("string")))
    return rows.select("path", F.array_join(F.transform(by_line, lambda f: f["n"]), ",").alias("functions"), F.array_join(F.array_sort(methods), ",").alias("methods"), F.length(by_line[0]["s"]).alias("snippet"))


@query(
    "usage_views",
    "P21 A11",
    f"""WITH {_FILES}, d AS (SELECT 'run' || k AS name, path FROM p UNION ALL SELECT 'f' || k, path FROM p UNION ALL SELECT 'wait', max_by(path, k) FROM p),
    c AS (SELECT 'f' || nx AS name, path || ':6:run' || k AS site FROM p UNION ALL SELECT 'helper', path || ':13:f' || k FROM p UNION ALL SELECT 'run' || k, path || ':14:f' || k FROM p UNION ALL SELECT 'C' || k, path || ':14:f' || k FROM p),
    g AS (SELECT name, count(*) AS n, min(site) AS first FROM c GROUP BY 1) SELECT coalesce(d.name, g.name) AS name, path AS defined_in, coalesce(n, 0) AS total_calls, first FROM d FULL JOIN g ON d.name = g.name""",
)
def usage_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _analysed(spark, sf_dir)
    shown = summaries.usage_view(found["usage"], found["calls"])
    sites = F.transform("called_in", lambda c: F.concat_ws(":", c["file_path"], c["line"].cast("string"), c["context"]))
    return shown.select("name", "defined_in", "total_calls", F.array_min(sites).alias("first"))


@query("chunk_logs", "A19", "WITH n AS (SELECT s_nationkey, count(*) AS n, list_transform(list(s_name ORDER BY s_suppkey)[1:5], lambda x: x) AS first FROM (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '?' ELSE s_name END AS s_name FROM supplier) GROUP BY 1) SELECT 'f' || s_nationkey || ': ' || n || ' chunks (' || array_to_string(first, ', ') || CASE WHEN n > 5 THEN '...' ELSE '' END || ')' AS line FROM n")
def chunk_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name"))
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("file_path"), F.col("s_suppkey").alias("ordinal"), name.alias("name"))
    return summaries.chunk_log(made).select("line")


@query(
    "enrichment_batches",
    "F9b T9 P21",
    f"""WITH {_FILES}, f AS (SELECT path, 4 AS children FROM p UNION ALL SELECT path, 0 FROM b), o AS (SELECT path, row_number() OVER (ORDER BY children DESC, path) - 1 AS place FROM f)
    SELECT (place // 3)::BIGINT AS batch, string_agg(path, ',' ORDER BY place) AS paths FROM o GROUP BY 1""",
)
def enrichment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _python_files(spark, sf_dir)
    batches = summaries.enrichment_batches(summaries.enrichment_rows(files, scan.symbols(scan.found(files, "symbol"))))
    paths = F.transform(F.from_json("files", "array<struct<path:string>>"), lambda f: f["path"])
    return batches.select("batch", F.array_join(paths, ",").alias("paths"))


@query("enrichment_inputs", "F9b", "SELECT doc_id, lang AS language, CASE WHEN length(text) > 3000 THEN left(text, 3000) || chr(10) || '// ... (truncated)' ELSE text END AS source FROM documents")
def enrichment_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))
    none = spark.createDataFrame([], "path string, kind string, name string, start_line int, end_line int, ordinal int")
    return summaries.enrichment_rows(d, none).select(F.col("path").cast("long").alias("doc_id"), "language", "source")


_NAMES = ["SBertModel", "kwModel", "anyModel", "nlpPipe", "cosUtil", "chat_client", "get_it", "create_it", "handle_it", "other"]


@query(
    "fallback_descriptions",
    "F20",
    f"""WITH r AS (SELECT p_partkey, ({_NAMES!r})[p_partkey % {len(_NAMES)} + 1] || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN 'Said at length of part ' || p_name ELSE 'short' END AS said FROM part)
    SELECT p_partkey, CASE WHEN length(said) >= 30 THEN said ELSE CASE p_partkey % {len(_NAMES)} WHEN 0 THEN 'A Sentence-BERT model instance used for generating sentence embeddings and computing semantic similarity between text.'
    WHEN 1 THEN 'A keyword extraction model instance used for extracting relevant keywords and keyphrases from text.' WHEN 2 THEN 'A model instance (' || name || ') used for processing and analyzing data.'
    WHEN 3 THEN 'A natural language processing pipeline instance (likely spaCy) used for text analysis, tokenization, and linguistic feature extraction.'
    WHEN 4 THEN 'A utility function for computing cosine similarity between vectors, typically used for measuring semantic similarity between text embeddings.'
    WHEN 5 THEN 'An OpenAI API client method for creating chat completions, used to interact with GPT models for text generation and analysis.'
    WHEN 6 THEN 'A function (' || name || ') that retrieves or fetches data from a source.' WHEN 7 THEN 'A function (' || name || ') that generates or creates new content or data.'
    WHEN 8 THEN 'A function (' || name || ') that processes or handles input data.' ELSE 'A code element (' || name || ') that performs operations as defined in the codebase.' END END AS description FROM r""",
)
def fallback_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.array(*[F.lit(n) for n in _NAMES])[(k % len(_NAMES)).cast("int")], k.cast("string"))
    said = F.when(k % 4 == 0, F.concat(F.lit("Said at length of part "), "p_name")).otherwise("short")
    return table(spark, sf_dir, "part").select("p_partkey", summaries.fallback_description(name, said).alias("description"))


@query("shallow_symbols", "X14", f"WITH {_FILES} SELECT path, 'class' AS kind, 'C' || k AS name, 4 AS start_line, 'class C' || k || '(Base' || k % 5 || '):' AS head FROM p UNION ALL SELECT path, 'function', 'f' || k, 11, 'def f' || k || '(x: str) -> str:' FROM p")
def shallow_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _python_files(spark, sf_dir)
    rows = summaries.shallow_symbols(files, scan.symbols(scan.found(files, "symbol")))
    return rows.select("path", "kind", "name", "start_line", F.substring_index("code_sample", "\n", 1).alias("head"))


@query("shallow_samples", "X14", "SELECT s_suppkey, 13 AS lines, '  // ... (truncated)' AS last FROM supplier")
def shallow_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of twenty lines shows twelve and a mark."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.concat(F.lit("a"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def f():\n"), F.repeat(F.lit("    go()\n"), 19)).alias("content"))
    rows = summaries.shallow_symbols(s, scan.symbols(scan.found(s.select("path", "content"), "symbol")))
    lines = F.split("code_sample", "\n", -1)
    return rows.join(s.select("path", "s_suppkey"), "path").select("s_suppkey", F.size(lines).alias("lines"), F.element_at(lines, -1).alias("last"))


@query(
    "graph_build",
    "G2 J1 U1",
    f"""WITH {_FILES}, a AS (SELECT path FROM p UNION ALL SELECT path FROM b), n AS (SELECT 'Folder' AS what, 1 + count(DISTINCT split_part(path, '/', 2)) AS n FROM a UNION ALL SELECT 'File', count(*) FROM a
    UNION ALL SELECT 'Class', count(*) FROM p UNION ALL SELECT 'Function', 3 * count(*) FROM p UNION ALL SELECT 'Method', 2 * count(*) FROM p
    UNION ALL SELECT 'CONTAINS', 2 * (SELECT count(*) FROM a) + 4 * count(*) FROM p UNION ALL SELECT 'HAS_METHOD', 2 * count(*) FROM p
    UNION ALL SELECT 'CALLS', count(*) FROM p WHERE nx IN (SELECT k FROM p)) SELECT what, n::BIGINT AS n FROM n""",
)
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each label and edges of each type the files make."""
    files, found = _analysed(spark, sf_dir)
    nodes, edges = analysis.build_graph(files, found)
    return nodes.groupBy(F.col("label").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@query(
    "code_snippets",
    "F15",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'line two' WHEN 1 THEN 'def ' || p_brand || '(a):' || chr(10) || '    pass' WHEN 2 THEN 'plain ' || p_name ELSE 'plain ' || p_name END AS snippet FROM part",
)
def code_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines asked for; else from the definition of the name on; else the beginning."""
    k = F.col("p_partkey") % 4
    content = F.when(k == 0, F.concat(F.lit("line one\nline two\n"), "p_name")).when(k == 1, F.concat(F.lit("x = 1\n\ndef "), "p_brand", F.lit("(a):\n    pass"))).otherwise(F.concat(F.lit("plain "), "p_name"))
    start, end = F.when(k == 0, 2).otherwise(99), F.when(k == 0, 2).otherwise(120)
    return table(spark, sf_dir, "part").select("p_partkey", generated.snippet(content, start, end, F.col("p_brand")).alias("snippet"))


@query("code_docstrings", "F17", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN length('Tells of ' || p_name || ' and more') > 20 THEN left('Tells of ' || p_name || ' and more', 800) END AS said FROM part")
def code_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, said = F.col("p_partkey") % 3, F.concat(F.lit("Tells of "), "p_name", F.lit(" and more"))
    code = F.when(k == 0, F.lit('def f():\n    """short"""\n')).when(k == 1, F.concat(F.lit("/**\n * "), said, F.lit("\n */\nfunction f() {}"))).otherwise(F.concat(F.lit("def f():\n    '''"), said, F.lit("'''\n")))
    return table(spark, sf_dir, "part").select("p_partkey", generated.docstring(code).alias("said"))


@query("clean_comments", "F22", "SELECT p_partkey, 'Look at ' || p_name || ' now' || chr(10) || 'use ' || p_brand AS said FROM part")
def clean_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("## 🚀 Look   at **"), "p_name", F.lit("** now\n- use `"), "p_brand", F.lit("` ⚠️ "))
    return table(spark, sf_dir, "part").select("p_partkey", cleaned_comment(raw).alias("said"))


@query("repaired_texts", "F23 F24", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE '{"name":"' || p_name || '","sizes":[' || p_size || ',1]}' END AS fixed FROM part""")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, with a trailing comma, cut off, or no JSON at all."""
    k, body = F.col("p_partkey") % 4, F.concat(F.lit('{"name": "'), "p_name", F.lit('", "sizes": ['), F.col("p_size").cast("string"), F.lit(", 1"))
    raw = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("]}\n```"))).when(k == 1, F.concat(body, F.lit(",],}"))).when(k == 2, F.concat(body, F.lit('], "rest": "unfini'))).otherwise("no braces")
    return table(spark, sf_dir, "part").select("p_partkey", generated.repair_json(raw).alias("fixed"))


@query("stripped_sources", "F34", "SELECT p_partkey, 'def f' || p_partkey || '():' || chr(10) || '    ' || chr(10) || '    return ' || p_size || chr(10) AS source FROM part")
def stripped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("def f"), F.col("p_partkey").cast("string"), F.lit('():\n    """Says what."""\n    return '), F.col("p_size").cast("string"), F.lit("\n"))
    strip = F.pandas_udf(lambda s: s.map(without_docstrings, na_action="ignore"), "string")
    return table(spark, sf_dir, "part").select("p_partkey", strip(code).alias("source"))


def _letters(texts: list[str]):
    """A model whose vectors SQL can make as well: how often each of eight letters occurs."""
    import numpy as np

    return np.array([[t.count(c) for c in "aeinorst"] for t in texts], dtype=np.float32).reshape(len(texts), 8)


_LETTERS = "list_transform(string_split('aeinorst', ''), lambda c: (length({0}) - length(replace({0}, c, '')))::FLOAT)"


@query("vector_points", "V2 S22 F9", f"SELECT p_partkey, array_to_string(list_transform({_LETTERS.format('body')}, lambda x: x::INT), ',') AS vector FROM (SELECT p_partkey, 'Function: ' || p_name || ' | File: f' || p_size || '.py' || chr(10) || chr(10) || p_type AS body FROM part)")
def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded by their labelled text, not by the bare content."""
    path = F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".py"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("function_name"), path.alias("file_path"), F.col("p_type").alias("content"))
    points = analysis.vectorize(rows, "c", lambda: _letters)
    return points.select(F.col("chunk_id").cast("long").alias("p_partkey"), F.array_join(F.col("vector").cast("array<int>").cast("array<string>"), ",").alias("vector"))
