"""From files to tables, graph and vectors: the whole analysis as one set of plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_id, embedding_text
from tessera.operators import chunks, graph, resolve
from tessera.operators.extract import scan
from tessera.operators.files import is_code, language, subsystem
from tessera.operators.lineage import by_shuffle, checkpointed
from tessera.operators.vector import point_id
from tessera.sources.embeddings import Embedder, embed_column, hashing_embedder

# Fixed value: how a dependency is stored as an edge.
EDGE_OF = {"import": "IMPORTS", "call": "CALLS", "extends": "INHERITS", "implements": "IMPLEMENTS"}


#: Begins a path that names its repository as its first folder, which no rule on folders knows.
_MARK = "\x1e"


def _qualified(repo: Column, name: Column) -> Column:
    return F.concat(F.lit(_MARK), F.translate(F.coalesce(repo, F.lit("")), "/", "\x1f"), F.lit("/"), name)


def _repo(name: Column) -> Column:
    return F.translate(F.regexp_extract(name, f"^{_MARK}([^/]*)/", 1), "\x1f", "/")


def _plain(rows: DataFrame, by: str, *names: str) -> DataFrame:
    """``rows`` with ``repo_id``, which ``by`` tells, and without it in ``by`` and ``names``."""
    bare = {n: F.regexp_replace(n, f"{_MARK}[^/]*/", "") for n in (by, *names)}
    return rows.withColumn("repo_id", _repo(F.col(by))).withColumns(bare)


def analyze(files: DataFrame, strategy: str = "hybrid") -> dict[str, DataFrame]:
    """symbols, imports, calls, usage, dependencies, chunks, subsystems and errors of ``files`` (repo_id, path, content, ordinal).

    Every table has ``repo_id``; names and paths of one repository never meet those of another. The files are parsed once;
    what the parser found is checkpointed, since six tables read it.
    """
    code = files.where(is_code(F.col("path"), F.col("content"))).withColumn("path", _qualified(F.col("repo_id"), F.col("path")))
    found = checkpointed(scan.found(code), sized=False)
    symbols, calls = scan.symbols(found), scan.calls(found)
    own = lambda c: _qualified(_repo(F.col("path")), F.col(c))
    calls = calls.withColumn("function_name", own("function_name"))
    functions = symbols.where("kind = 'function'")
    # places: files in their order, functions in theirs within a file; of equal ids the first counts, of equal names the last
    placed = functions.join(by_shuffle(code.select("path", F.col("ordinal").alias("_file"))), "path").withColumn("place", F.struct("_file", "path", "ordinal"))
    defined = placed.withColumn("name", own("name")).withColumn("ordinal", F.col("place"))
    sites = resolve.containing(calls, functions.select("path", "name", "start_line", "end_line"))
    imported = resolve.resolve_imports(scan.imports(found).select("from_path", "source"), code.select("path", "ordinal"))
    imports = scan.imports(found).join(imported, ["from_path", "source"], "left").select("from_path", F.coalesce("to_path", "source").alias("to_path"), F.lit("import").alias("type"), F.concat_ws(",", "imports").alias("relationship"))
    dependencies = imports.unionByName(scan.inheritance(found)).unionByName(resolve.call_dependencies(calls, defined))
    named = placed.select(F.concat_ws(":", "path", "name").alias("id"), "path", own("name").alias("name"), F.col("body").alias("content"), "place")
    named = graph.first_wins(named, "id", "place")
    called = sites.where("context is not null").select(F.concat_ws(":", "path", "context").alias("source_id"), F.col("function_name").alias("name"))
    made = chunks.create_chunks(strategy, code, symbols.where("kind != 'property'").select("path", "kind", "name", "parent", "start_line", "end_line", "ordinal"), named, called)
    bare_id = F.regexp_replace("id", "^flow:", "")
    made = made.withColumn("repo_id", _repo(bare_id)).withColumns({c: F.regexp_replace(c, f"{_MARK}[^/]*/", "") for c in ("id", "content", "file_path") if c in made.columns})
    if "members" in made.columns:
        made = made.withColumn("members", F.transform("members", lambda m: F.regexp_replace(m, f"{_MARK}[^/]*/", "")))
    return {
        "symbols": _plain(symbols, "path"),
        "imports": _plain(scan.imports(found), "from_path"),
        "calls": _plain(sites, "path", "function_name"),
        "usage": _plain(resolve.usage(calls, defined), "name", "defined_in"),
        "dependencies": _plain(dependencies, "from_path", "to_path", "relationship"),
        "chunks": made,
        "subsystems": files.where(is_code(F.col("path"), F.col("content"))).groupBy("repo_id", subsystem(F.col("path")).alias("subsystem")).agg(F.count(F.lit(1)).alias("files")),
        "errors": _plain(scan.errors(found), "path"),
    }


def build_graph(files: DataFrame, analysis: dict[str, DataFrame], repo_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one repository: folders and files, their symbols, and dependencies between files that exist.

    ``repo_id`` says which where ``files`` hold several, since ids come from paths."""
    if repo_id is not None:
        files = files.where(F.col("repo_id") == repo_id)
        analysis = {name: rows.where(F.col("repo_id") == repo_id) for name, rows in analysis.items()}
    code = files.where(is_code(F.col("path"), F.col("content"))).withColumn("path", graph.normal_path(F.col("path")))
    prefixes = graph.path_prefixes(code.select("path", "ordinal"))
    line = F.col("start_line").cast("string")
    s = analysis["symbols"].where("kind in ('function', 'class', 'method')").withColumn("path", graph.normal_path(F.col("path")))
    label = F.initcap("kind")
    sid = F.when(F.col("kind") == "method", content_id(label, F.col("path"), F.col("parent"), F.col("name"), line)).otherwise(content_id(label, F.col("path"), F.col("name"), line))
    s = s.select(sid.alias("id"), label.alias("label"), "name", "path", "parent", "start_line", "end_line", "ordinal")
    tree = graph.hierarchy_nodes(prefixes, "ordinal").join(by_shuffle(code.select(F.col("path").alias("prefix"), language(F.col("path"), F.lit(None).cast("string")).alias("language"))), "prefix", "left")
    folders = tree.select("id", "label", "name", F.col("prefix").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    nodes = folders.unionByName(graph.first_wins(s.select("id", "label", "name", "path", "start_line", "end_line", "ordinal"), "id", "ordinal").drop("ordinal"))
    file_id = content_id(F.lit("File"), F.col("path"))

    def edge(rows: DataFrame, kind, source, target, *more) -> DataFrame:
        return rows.select(content_id(kind, *(more or (source, target))).alias("id"), kind.alias("type"), source.alias("source_id"), target.alias("target_id"))

    inside = edge(s.where("label != 'Method'"), F.lit("CONTAINS"), file_id, F.col("id"))
    classes = s.where("label = 'Class'").groupBy("path", F.col("name").alias("parent")).agg(F.min_by("id", "start_line").alias("class_id"))
    methods = edge(s.where("label = 'Method'").join(classes, ["path", "parent"]), F.lit("HAS_METHOD"), F.col("class_id"), F.col("id"))
    kind = F.create_map(*[F.lit(x) for pair in EDGE_OF.items() for x in pair])[F.col("type")]
    d = analysis["dependencies"].where(F.col("type").isin(*EDGE_OF))
    between = edge(d, kind, content_id(F.lit("File"), F.col("from_path")), content_id(F.lit("File"), F.col("to_path")), F.col("from_path"), F.col("to_path"), F.col("relationship"))
    edges = graph.hierarchy_edges(prefixes).unionByName(inside).unionByName(methods).unionByName(graph.referential(between, nodes))
    return nodes, edges


def scored_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with community, risk score and risk level where the label is scored."""
    symbols = nodes.where(F.col("label").isin(*graph.SYMBOL_LABELS)).select("id")
    links = graph.referential(edges.where(F.col("type").isin(*graph.COMMUNITY_EDGES)), symbols)
    communities = graph.communities_by_modularity(symbols, links)
    sizes = communities.groupBy("community").count().where("count >= 2").select("community")
    scored = nodes.where(F.col("label").isin(*graph.SCORED_LABELS))
    risks = graph.risk_scores(scored.select("id", "start_line", "end_line"), edges.where(F.col("type").isin(*graph.RISK_EDGES)), communities.join(sizes, "community", "left_semi"))
    return nodes.join(communities, "id", "left").join(risks.select("id", "risk_score", "risk_level"), "id", "left")


def embedded_text(chunk_rows: DataFrame) -> Column:
    """The labelled text of a chunk, from whichever of the known columns there are."""
    none, lists = F.lit(None).cast("string"), F.array().cast("array<string>")
    text = lambda c: F.col(c) if c in chunk_rows.columns else none
    many = lambda c: F.col(c) if c in chunk_rows.columns else lists
    return embedding_text(text("function_name"), text("class_name"), text("file_path"), text("subsystem"), many("calls"), many("dependencies"), text("summary"), many("keywords"), F.col("content"))


def vectorize(chunk_rows: DataFrame, collection: str, load: Callable[[], Embedder] = hashing_embedder) -> DataFrame:
    """(collection, point_id, chunk_id, content, vector): chunks ready for the vector store, embedded by their labelled text."""
    vector = embed_column(embedded_text(chunk_rows), load).alias("vector")
    return chunk_rows.select(F.lit(collection).alias("collection"), point_id(F.col("id")).alias("point_id"), F.col("id").alias("chunk_id"), "content", vector)
