"""Folder trees as adjacency rows: depths, child counts, groups, descriptions; nested JSON at the sink only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed


def nodes(prefixes: DataFrame) -> DataFrame:
    """(path, parent, name, type, depth): one row per folder and file of ``graph.path_prefixes``."""
    rows = prefixes.select(F.col("prefix").alias("path"), "parent", "name", F.lower("label").alias("type"), "depth")
    # a path that is a file and a folder is the folder
    return rows.groupBy("path").agg(F.max_by(F.struct("parent", "name", "type", "depth"), "type").alias("n")).select("path", "n.*")


def min_file_depth(prefixes: DataFrame) -> DataFrame:
    """(path, min_depth): steps from each folder down to its nearest file. Every file names all its folders, so no recursion is needed."""
    files = prefixes.where("label = 'File'").select(F.split("prefix", "/").alias("parts"))
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.struct(F.array_join(F.slice("parts", F.lit(1), k), "/").alias("path"), (F.size("parts") - k).alias("steps")))
    return files.where("size(parts) > 1").select(F.inline(above)).groupBy("path").agg(F.min("steps").alias("min_depth"))


def child_counts(tree: DataFrame) -> DataFrame:
    """(path, files, folders) of each folder with children."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("path"))
    return kids.agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "folder").alias("folders"))


def root_groups(tree: DataFrame, most: int = 60) -> DataFrame:
    """(group, path, rank): files by first folder, at most ``most`` each; the group of root files is `(root files)`."""
    parts = F.split("path", "/")
    group = F.when(F.size(parts) > 1, parts[0]).otherwise("(root files)")
    rank = F.row_number().over(Window.partitionBy("group").orderBy("path"))
    return tree.where("type = 'file'").select(group.alias("group"), "path").withColumn("rank", rank).where(F.col("rank") <= most)


def group_order() -> list[Column]:
    """Root files last, else by name without case."""
    return [(F.col("group") == "(root files)").asc(), F.lower("group").asc(), F.col("group").asc()]


def description(kind: Column, name: Column, files: Column, folders: Column) -> Column:
    files, folders = F.coalesce(files, F.lit(0)), F.coalesce(folders, F.lit(0))
    return (
        F.when(kind == "folder", F.concat(F.lit("Folder "), name, F.lit(" with "), files.cast("string"), F.lit(" files and "), folders.cast("string"), F.lit(" folders")))
        .when(kind == "file", F.concat(F.lit("File "), name))
        .otherwise(F.concat(F.lit("Symbol "), name))
    )


def graft(tree: DataFrame, described: DataFrame) -> DataFrame:
    """``tree`` with summary and description of the rows of the same path; what the tree has is kept."""
    d = described.select(F.col("path").alias("_p"), F.col("summary").alias("_s"), F.col("description").alias("_d"))
    j = tree.join(d, F.col("path") == F.col("_p"), "left")
    return j.withColumns({"summary": F.coalesce("summary", "_s"), "description": F.coalesce("description", "_d")}).drop("_p", "_s", "_d")


def folded(tree: DataFrame) -> DataFrame:
    """(path, parent, name, type, depth, size, files, json) of each node with all below it as nested JSON, children by name.

    Level by level from the deepest: the children of a folder are strings by the time it is made, so a level is one grouping of
    the level below and one join, and no path is sorted as a whole. ``size`` and ``files`` count the nodes and the files of
    the subtree, itself included. A node's JSON is as long as its subtree: ask for those that go to a sink."""
    rows = checkpointed(tree.select("path", "parent", "name", "type", "depth"))
    deepest = rows.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        own = rows.where(F.col("depth") == depth)
        head = F.to_json(F.struct("name", "path", "type"))
        if levels:
            told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "json"))), lambda k: k["json"]), ",")
            kids = levels[-1].groupBy(F.col("parent").alias("_p")).agg(told.alias("_kids"), F.sum("size").alias("_size"), F.sum("files").alias("_files"))
            own = own.join(kids, F.col("path") == F.col("_p"), "left")
        else:
            own = own.withColumns({"_kids": F.lit(""), "_size": F.lit(0), "_files": F.lit(0)})
        text = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"children":['), F.coalesce("_kids", F.lit("")), F.lit("]}"))
        counted = F.coalesce("_files", F.lit(0)) + F.when(F.col("type") == "file", 1).otherwise(0)
        levels.append(checkpointed(own.select("path", "parent", "name", "type", "depth", (1 + F.coalesce("_size", F.lit(0))).cast("long").alias("size"), counted.cast("long").alias("files"), text.alias("json"))))
    return reduce(DataFrame.unionByName, levels) if levels else rows.select("*", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("files"), F.lit("").alias("json"))


def areas(tree: DataFrame, most: int = 60) -> DataFrame:
    """(group, files, json): the feature view where no model names features: a component for each first folder, with its first
    ``most`` files by path as they are in the code tree, and one for the files of the root."""
    shown = root_groups(tree, most).join(folded(tree).select("path", F.col("json").alias("_json")), "path")
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_json"))), lambda k: k["_json"]), ",")
    head = F.to_json(F.struct(F.col("group").alias("name"), F.lit("").alias("path"), F.lit("component").alias("type"), F.concat(F.lit("Code area: "), "group").alias("description")))
    rows = shown.groupBy("group").agg(held.alias("_kids"), F.count(F.lit(1)).alias("files"))
    return rows.select("group", "files", F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"children":['), "_kids", F.lit("]}")).alias("json"))


# How much of a repository a prompt shows.
TOP_FOLDERS, ROOT_FILES, COMPACT_FILES, COMPACT_SYMBOLS = 80, 60, 500, 20


def compact(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, symbols): the first files by path with the first names in each."""
    files = tree.where("type = 'file'").select("path").orderBy("path").limit(COMPACT_FILES)
    named = symbols.join(F.broadcast(files), "path", "left_semi").groupBy("path").agg(F.slice(F.sort_array(F.collect_list(F.struct("start_line", "name"))), 1, COMPACT_SYMBOLS).alias("s"))
    return files.join(named, "path", "left").select("path", F.coalesce(F.transform("s", lambda x: x["name"]), F.array().cast("array<string>")).alias("symbols"))


def top_folders(tree: DataFrame) -> DataFrame:
    """(kind, path): the first folders of the root and the first files in it, by name."""
    at_root = tree.where("parent is null")
    folders = at_root.where("type = 'folder'").select(F.lit("folder").alias("kind"), "path").orderBy("path").limit(TOP_FOLDERS)
    return folders.unionByName(at_root.where("type = 'file'").select(F.lit("file").alias("kind"), "path").orderBy("path").limit(ROOT_FILES))


def missing(tree: DataFrame, described: DataFrame) -> DataFrame:
    """Paths that still have no description: the next batch to ask for."""
    return tree.select("path").join(described.where("description is not null").select("path"), "path", "left_anti")


def markdown(sections: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, section, depth, title, body): headings by depth, in order of ``section``.

    ``section`` is a sortable path such as `0001.0002`, so any nesting depth is a flat sort within the document.
    """
    part = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6)).cast("int")), F.lit(" "), "title", F.lit("\n\n"), F.coalesce("body", F.lit("")))
    rows = sections.select("doc_id", F.struct("section", part.alias("part")).alias("s"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["part"]), "\n\n").alias("text"))
