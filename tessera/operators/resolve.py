"""Name and path resolution: calls to definitions, uses, relative imports, containment, related chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.contain import occurrences
from tessera.operators.graph import last_wins
from tessera.operators.lineage import by_shuffle

# Fixed value: ends tried for a relative import, in this order.
CANDIDATE_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx")
#: About how many related chunks travel together. It changes the speed only.
LIST = 64


def call_dependencies(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Cross-file `call` dependencies: of definitions with one name the last wins, every call site counts."""
    defined = last_wins(definitions.select("name", "path", "ordinal"), "name", "ordinal").select("name", F.col("path").alias("to_path"))
    found = calls.join(defined, calls["function_name"] == defined["name"]).where(F.col("path") != F.col("to_path"))
    return found.select(F.col("path").alias("from_path"), "to_path", F.lit("call").alias("type"), F.col("function_name").alias("relationship"))


def usage(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(name, defined_in, total_calls) for names that are defined or called or both."""
    defined = last_wins(definitions.select("name", "path", "ordinal"), "name", "ordinal").select("name", F.col("path").alias("defined_in"))
    called = calls.groupBy(F.col("function_name").alias("name")).agg(F.count(F.lit(1)).alias("total_calls"))
    return defined.join(called, "name", "full_outer").select("name", "defined_in", F.coalesce("total_calls", F.lit(0)).cast("long").alias("total_calls"))


def joined_path(folder: Column, relative: Column) -> Column:
    """``relative`` seen from ``folder``, `.` and `..` resolved."""
    parts = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), relative), "/")

    def walk(acc: Column, s: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s.isin("", "."), acc).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, source, to_path): the file a relative import means, null if there is none.

    Candidates are tried in order; each first for an exact path, then for the first file that begins with it
    (its extension left out). Both are equi-joins: a path is cut to the lengths that such beginnings have in one of the
    folders it lies in or below, and the first file of each beginning is found once. So a folder costs the sum of its
    files and imports, times the lengths of names.
    """
    folder = F.regexp_replace("from_path", "/?[^/]*$", "")
    base = F.when(F.col("source").startswith("."), joined_path(folder, F.col("source")))
    asked = imports.select("from_path", "source", base.alias("base")).distinct()
    ends = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("end")) for i, e in enumerate(CANDIDATE_ENDS)])
    bases = asked.select("base").where("base is not null").distinct()
    tries = bases.select("base", F.inline(ends)).withColumn("candidate", F.concat("base", "end"))
    paths = by_shuffle(files.select(F.col("path").alias("candidate"), F.struct("ordinal", "path").alias("first")))
    exact = tries.join(paths, "candidate").select("base", (F.col("rank") * 2).alias("k"), "first")
    stem = F.regexp_replace("candidate", r"\.(tsx?|jsx?)$", "")
    stems = tries.groupBy("base", stem.alias("stem")).agg(F.min("rank").alias("rank"))
    lengths = stems.groupBy(F.regexp_replace("stem", "/?[^/]*$", "").alias("folder")).agg(F.collect_set(F.length("stem")).alias("lengths"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    placed = files.select("path", "ordinal", F.explode(above).alias("folder")).join(lengths, "folder")
    cut = placed.select("path", "ordinal", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    begun = cut.groupBy(F.left("path", F.col("n")).alias("stem")).agg(F.min(F.struct("ordinal", "path")).alias("first"))
    found = exact.unionByName(stems.join(begun, "stem").select("base", (F.col("rank") * 2 + 1).alias("k"), "first"))
    best = found.groupBy("base").agg(F.min(F.struct("k", "first")).alias("b")).select("base", F.col("b.first.path").alias("to_path"))
    return asked.join(best, "base", "left").select("from_path", "source", "to_path")


def containing(sites: DataFrame, functions: DataFrame, innermost: bool = False) -> DataFrame:
    """Each call site with the ``context`` function whose lines contain it: the one that begins first, or the innermost.

    Sites without a function keep a null. For the first one, functions and sites of a file are gone through in order of lines, so
    a file costs the sum of both: functions that end before or with an earlier one contain no line for which they count, and
    of the others, whose ends rise with their starts, it is the first that has not ended. Equal sites are one row."""
    f = functions.select(F.col("path").alias("_path"), "start_line", "end_line", F.coalesce("name", F.lit("anonymous")).alias("_name"))
    keys = sites.columns
    if innermost:
        hit = (F.col("path") == F.col("_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
        number = F.row_number().over(Window.partitionBy("_path").orderBy("start_line", F.desc("end_line"), "_name"))
        f = f.withColumn("_n", number)
        # a line's innermost function as a number: sums of pairs are kept in a table of numbers, nothing is sorted by names
        best = sites.select("path", "line").distinct().join(f, hit).groupBy("path", "line").agg(F.max("_n").alias("_n"))
        named = best.join(f.select(F.col("_path").alias("path"), "_n", F.col("_name").alias("context")), ["path", "_n"]).drop("_n")
        return sites.distinct().join(named, ["path", "line"], "left").select(*keys, "context")
    before = Window.partitionBy("_path").orderBy("start_line", F.desc("end_line"), "_name").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_line").over(before)
    outer = f.withColumn("_reach", reach).where("_reach is null or end_line > _reach")
    marks = outer.select(F.col("_path").alias("path"), F.col("end_line").alias("_at"), F.lit(1).alias("_kind"), F.struct("start_line", "_name").alias("_f"), F.lit(None).cast(sites.select(F.struct(*keys)).schema[0].dataType).alias("_s"))
    asked = sites.distinct().select("path", F.col("line").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(marks.schema["_f"].dataType).alias("_f"), F.struct(*keys).alias("_s"))
    behind = Window.partitionBy("path").orderBy("_at", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = marks.unionByName(asked).withColumn("_next", F.first("_f", ignorenulls=True).over(behind)).where("_kind = 0")
    inside = F.col("_next.start_line") <= F.col("_at")
    return met.select("_s.*", F.when(inside, F.col("_next._name")).alias("context"))


def _lists(targets: DataFrame, *key: str) -> DataFrame:
    """(…key, related array): what each key means, ``targets`` (…key, related) once each in lists of about ``LIST``."""
    count = F.count(F.lit(1)).over(Window.partitionBy(*key))
    piece = F.pmod(F.xxhash64("related"), F.ceil(count / LIST))
    found = F.sort_array(F.collect_set("related"))
    found = F.when(F.bool_or(F.col("related").isNull()), F.array_append(found, F.lit(None))).otherwise(found)
    rows = targets.where(" and ".join(f"{k} is not null" for k in key)).withColumn("_piece", piece)
    return rows.groupBy(*key, "_piece").agg(found.alias("related")).drop("_piece")


def related_chunks(chunks: DataFrame) -> DataFrame:
    """(id, related): chunks linked by a called name, by a file dependency, or by a caller `file:name`; distinct pairs.

    Three equi-joins. What a name or a file means is shuffled as short lists, and lists are dealt by the chunk that asks before
    they become pairs, so pairs aren't shuffled; a chunk in demand is many lists and not a huge one.
    """
    other = chunks.select(F.col("id").alias("related"), F.col("function_name").alias("_fn"), F.col("file_path").alias("_file"))
    by_call = chunks.select("id", F.explode("calls").alias("_fn")).join(_lists(other.select("_fn", "related"), "_fn"), "_fn").select("id", "related")
    by_file = chunks.select("id", F.explode("dependencies").alias("_file")).join(_lists(other.select("_file", "related"), "_file"), "_file").select("id", "related")
    caller = F.regexp_extract("c", "^(.*):([^:]*)$", 1), F.regexp_extract("c", "^(.*):([^:]*)$", 2)
    callers = chunks.select("id", F.explode("called_by").alias("c")).select("id", caller[0].alias("_file"), caller[1].alias("_fn"))
    by_caller = callers.join(_lists(other, "_file", "_fn"), ["_file", "_fn"]).select("id", "related")
    met = by_call.unionByName(by_file).unionByName(by_caller).repartition("id")
    return met.select("id", F.explode("related").alias("related")).distinct()


def symbol_uses(symbols: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """(name, own_path, path, rank): the first ``most`` other files whose text contains the symbol's name.

    Null and empty names are used nowhere. The bound on the rank cuts each group before the shuffle.
    """
    s = symbols.select("name", F.col("path").alias("own_path"))
    hits = occurrences(files.select("path", "ordinal", "content"), s).join(s, "name").where(F.col("path") != F.col("own_path"))
    rank = F.row_number().over(Window.partitionBy("name", "own_path").orderBy("ordinal"))
    return hits.select("name", "own_path", "path", rank.alias("rank")).where(F.col("rank") <= most)


def normal_reference(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "_", "")


def resolve_references(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ref, chunk_id): the first chunk by rank whose function, class or method has the name; null if none has."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), normal_reference(F.col(c)).alias("key")) for i, c in enumerate(("function_name", "class_name", "method_name"))])
    named = chunks.select("id", "chunk_rank", F.inline(kinds)).where("key is not null and key != ''")
    best = named.groupBy("key").agg(F.min_by("id", F.struct("chunk_rank", "kind")).alias("chunk_id"))
    return references.select("ref", normal_reference(F.col("ref")).alias("key")).join(best, "key", "left").select("ref", "chunk_id")


def _bare(name: Column) -> Column:
    return F.translate(name, "_", "")


def unmatched_references(resolved: DataFrame, chunks: DataFrame, context: int = 5) -> DataFrame:
    """(ref, chunk_id, context) for unresolved references: the first chunk one of whose lines contains the name, as it is or
    with underscores left out on both sides, and that line with ``context`` lines to either side. The case of letters counts.

    A name with a line break is in no line; one of which nothing is left without underscores matches as it is only. Only the
    chunk that is found is cut into lines: the line is the number of breaks before the first occurrence of either form.
    """
    open_ = resolved.where("chunk_id is null").select("ref", _bare(F.col("ref")).alias("bare")).distinct()
    asked = open_.where(~F.contains("ref", F.lit("\n")))
    rows = chunks.select("id", "chunk_rank", "content")
    exact = occurrences(rows, asked, name="ref").withColumnRenamed("name", "ref")
    stripped = occurrences(rows.withColumn("content", _bare(F.col("content"))), asked, name="bare").withColumnRenamed("name", "bare")
    first = lambda hits, key: hits.groupBy(key).agg(F.min(F.struct("chunk_rank", "id")).alias("c"))
    found = first(exact, "ref").unionByName(asked.join(first(stripped, "bare"), "bare").select("ref", "c"))
    best = found.groupBy("ref").agg(F.min("c").alias("c")).select("ref", F.col("c.id").alias("chunk_id"), _bare(F.col("ref")).alias("bare"))
    line = lambda name, text: F.when((F.length(name) > 0) & F.contains(text, name), F.size(F.split(F.left(text, F.position(name, text) - 1), "\n")))
    shown = best.join(rows.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").withColumn("_at", F.least(line(F.col("ref"), F.col("content")), line(F.col("bare"), _bare(F.col("content")))))
    start = F.greatest(F.col("_at") - context, F.lit(1))
    text = F.array_join(F.slice(F.split("content", "\n"), start, F.col("_at") + context + 1 - start), "\n")
    return open_.select("ref").join(shown.select("ref", "chunk_id", text.alias("context")), "ref", "left")


def calls_made(sites: DataFrame) -> DataFrame:
    """(path, context, calls): the names called within each function; ``sites`` have a context, those without are left out."""
    known = sites.where("context is not null")
    return known.groupBy("path", "context").agg(F.sort_array(F.collect_list("function_name")).alias("calls"))


def called_by(sites: DataFrame) -> DataFrame:
    """(function_name, caller): a `path:context` row per call site, `unknown` where there is no context."""
    return sites.select("function_name", F.concat_ws(":", "path", F.coalesce("context", F.lit("unknown"))).alias("caller"))


def file_dependencies(dependencies: DataFrame) -> DataFrame:
    """(path, dependencies): what each file depends on, repeats kept."""
    return dependencies.groupBy(F.col("from_path").alias("path")).agg(F.sort_array(F.collect_list("to_path")).alias("dependencies"))
