"""What is shown of an analysis: summaries of symbols, usage, chunks and counters, and rows for a text generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lines_between
from tessera.operators.lineage import by_shuffle, checkpointed

# What a reader sees of long texts.
SNIPPET_CHARS, SOURCE_CHARS, LOGGED, SHALLOW_LINES, SHALLOW_CHARS, BATCH = 500, 3000, 5, 12, 1500, 3
SOURCE_MARK, SHALLOW_MARK = "\n// ... (truncated)", "  // ... (truncated)"
# Words in a name, in this order, and what is said of it; {} stands for the name.
FALLBACKS = (
    (("model", "bert"), "A Sentence-BERT model instance used for generating sentence embeddings and computing semantic similarity between text."),
    (("model", "kw|keyword"), "A keyword extraction model instance used for extracting relevant keywords and keyphrases from text."),
    (("model",), "A model instance ({}) used for processing and analyzing data."),
    (("nlp",), "A natural language processing pipeline instance (likely spaCy) used for text analysis, tokenization, and linguistic feature extraction."),
    (("util|cos|sim",), "A utility function for computing cosine similarity between vectors, typically used for measuring semantic similarity between text embeddings."),
    (("client", "chat"), "An OpenAI API client method for creating chat completions, used to interact with GPT models for text generation and analysis."),
    (("get_|fetch_|retrieve_",), "A function ({}) that retrieves or fetches data from a source."),
    (("generate_|create_",), "A function ({}) that generates or creates new content or data."),
    (("process_|handle_",), "A function ({}) that processes or handles input data."),
    ((), "A code element ({}) that performs operations as defined in the codebase."),
)


def fallback_description(name: Column, said: Column) -> Column:
    """``said`` if it has 30 signs or more, else a sentence by the words in the name."""
    chosen = None
    for words, sentence in FALLBACKS:
        before, mark, after = sentence.partition("{}")
        text = F.concat(F.lit(before), name, F.lit(after)) if mark else F.lit(sentence)
        hit = F.lit(True)
        for w in words:
            hit = hit & F.lower(name).rlike(w)
        chosen = F.when(hit, text) if chosen is None else chosen.when(hit, text)
    return F.when(F.length(said) >= 30, said).otherwise(chosen)


def symbol_summary(symbols: DataFrame) -> DataFrame:
    """(path, functions, classes): of functions the first signs of the body, of methods the number of parameters."""
    typed = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type")))
    function = F.struct("ordinal", "name", typed.alias("parameters"), "return_type", "is_async", "is_exported", "start_line", "end_line", F.substring(F.coalesce("body", F.lit("")), 1, SNIPPET_CHARS).alias("snippet"))
    method = F.struct("ordinal", "name", F.size(F.coalesce("parameters", F.array())).alias("parameters"))
    attribute = F.struct("ordinal", "name", "return_type")
    declared = F.struct("ordinal", "name", "extends", "is_exported", "start_line", "end_line")
    kind, owner = F.col("kind"), F.when(F.col("kind") == "class", F.col("name")).when(F.col("kind") != "function", F.col("parent"))
    all_of = lambda name, value: F.collect_list(F.when(kind == name, value))
    some = lambda listed: F.when(F.size(listed) > 0, F.sort_array(listed))
    # members come to the classes of their name, then classes and functions to their file
    wanted = symbols.where("kind = 'function' or (kind in ('class', 'method', 'property') and coalesce(if(kind = 'class', name, parent), '') != '')")
    owned = wanted.groupBy("path", owner.alias("_owner")).agg(all_of("function", function).alias("f"), all_of("class", declared).alias("c"), some(all_of("method", method)).alias("m"), some(all_of("property", attribute)).alias("p"))
    classes = F.transform("c", lambda c: F.struct(c["ordinal"].alias("ordinal"), c["name"].alias("name"), F.col("m").alias("methods"), F.col("p").alias("properties"), c["extends"].alias("extends"), c["is_exported"].alias("is_exported"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line")))
    by_file = owned.groupBy("path").agg(some(F.flatten(F.collect_list("f"))).alias("functions"), some(F.flatten(F.collect_list(classes))).alias("classes"))
    return by_file.where("functions is not null or classes is not null")


def dependency_view(dependencies: DataFrame) -> DataFrame:
    return dependencies.select(F.col("from_path").alias("from"), F.col("to_path").alias("to"), "type", "relationship")


def usage_view(usage: DataFrame, sites: DataFrame) -> DataFrame:
    """(name, defined_in, called_in, total_calls): each name with its call sites in order."""
    called = sites.groupBy(F.col("function_name").alias("name")).agg(F.sort_array(F.collect_list(F.struct(F.col("path").alias("file_path"), "line", "context"))).alias("called_in"))
    return usage.join(called, "name", "left").select("name", "defined_in", F.coalesce("called_in", F.array().cast(called.schema["called_in"].dataType)).alias("called_in"), "total_calls")


def chunk_log(chunks: DataFrame) -> DataFrame:
    """(file_path, chunks, line): how many chunks a file has and the first names, `?` for none, with dots if there are more."""
    named = F.struct("ordinal", F.coalesce(F.nullif("name", F.lit("")), F.lit("?")).alias("name"))
    rows = chunks.groupBy("file_path").agg(F.sort_array(F.collect_list(named)).alias("s"))
    first = F.array_join(F.transform(F.slice("s", 1, LOGGED), lambda x: x["name"]), ", ")
    line = F.concat("file_path", F.lit(": "), F.size("s").cast("string"), F.lit(" chunks ("), first, F.when(F.size("s") > LOGGED, "...").otherwise(""), F.lit(")"))
    return rows.select("file_path", F.size("s").alias("chunks"), line.alias("line"))


def counters(files: DataFrame, symbols: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: how many files, chunks, functions, classes, constants, methods, routes, default exports and errors."""
    kinds = ("function", "class", "constant", "method", "route", "default_export")
    counted = symbols.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(files, "files").join(one(chunks, "chunks")).join(one(errors, "errors")).join(counted)


def enrichment_rows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, language, source, symbols): what a generator is told of a file; long sources are cut and marked."""
    listed = symbols.where("kind in ('function', 'class')").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name", F.col("kind").alias("type"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end")))).alias("s"))
    source = F.when(F.length("content") > SOURCE_CHARS, F.concat(F.substring("content", 1, SOURCE_CHARS), F.lit(SOURCE_MARK))).otherwise(F.col("content"))
    told = F.transform(F.coalesce("s", F.array().cast(listed.schema["s"].dataType)), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))
    return by_shuffle(files).join(listed, "path", "left").select("path", F.coalesce("language", F.lit("")).alias("language"), source.alias("source"), told.alias("symbols"), F.size(told).alias("children"))


def enrichment_batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, files): JSON of ``size`` files each, those with the most symbols first. The files are sorted by ranges; the place of
    one is its place in its range after the counts of the ranges before, so that no window sees all files."""
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    ordered = rows.repartitionByRange(F.desc("children"), "path").sortWithinPartitions(F.desc("children"), "path")
    ordered = checkpointed(ordered.select("path", "language", "source", "symbols", F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("within")), sized=False)
    # a row for each range
    counts = ordered.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("offset"))
    placed = ordered.join(F.broadcast(before), "range").withColumn("place", F.col("offset") + F.col("within"))
    told = F.struct("place", F.struct("path", "language", "source", "symbols").alias("file"))
    grouped = placed.groupBy(F.floor(F.col("place") / size).alias("batch")).agg(F.sort_array(F.collect_list(told)).alias("f"))
    return grouped.select("batch", F.to_json(F.transform("f", lambda x: x["file"])).alias("files"))


def shallow_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, kind, name, start_line, end_line, code_sample): functions and classes that stand in no other, with their first lines.

    The window goes over the symbols of one file."""
    wanted = symbols.where("kind in ('function', 'class')").select("path", "kind", "name", "start_line", "end_line")
    before = Window.partitionBy("path").orderBy("start_line", F.desc("end_line"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    top = wanted.withColumn("_end", F.max("end_line").over(before)).where("_end is null or start_line > _end").drop("_end")
    last = F.least("end_line", F.col("start_line") + SHALLOW_LINES - 1)
    cut = lines_between(F.col("content"), F.col("start_line"), last)
    sample = F.when(F.col("end_line") > last, F.concat(cut, F.lit("\n" + SHALLOW_MARK))).otherwise(cut)
    return top.join(by_shuffle(files.select("path", "content")), "path").select("path", "kind", "name", "start_line", "end_line", F.substring(sample, 1, SHALLOW_CHARS).alias("code_sample"))
