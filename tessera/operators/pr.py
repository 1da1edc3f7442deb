"""Pull requests: size and issue points, noise filters, unified diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points and wording of the risk model.
CRITICAL_PATHS = "auth|security|database|core|main"
SOFT_PATHS = "schema|config"
GENERATED_PATHS = "schema|config|prompt|template"
BREAKING_TYPES = ("security", "breaking_change", "bug")
FILE_POINTS = ((20, 25), (10, 15), (5, 8))
LINE_POINTS = ((2000, 25), (1000, 15), (500, 8))
DELETION_POINTS = ((500, 20), (200, 10))
LEVELS = ((70, "critical"), (50, "very high"), (30, "high"), (15, "medium"))
DESCRIPTION_NOISE = "pr description|pull request description|description missing|description is|description could|description should"
RESCUE_WORDS = "security|performance|bug|error|crash|breaking"
MINOR_TYPES = ("style", "formatting", "naming")
OPENINGS = {
    "critical": "This PR contains changes that may break the codebase. ",
    "very high": "This PR has significant changes that require careful review. ",
    "high": "This PR has notable changes that should be reviewed. ",
    "medium": "This PR has moderate changes. ",
    "low": "This PR appears to be low risk. ",
}


def above(value: Column, points: tuple[tuple[int, int], ...]) -> Column:
    out = None
    for bound, n in points:
        out = F.when(value > bound, n) if out is None else out.when(value > bound, n)
    return out.otherwise(0)


def level(score: Column) -> Column:
    out = None
    for bound, name in LEVELS:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise("low")


def is_critical_path(path: Column) -> Column:
    return F.lower(path).rlike(CRITICAL_PATHS) & ~F.lower(path).rlike(SOFT_PATHS)


def is_noise(kind: Column, severity: Column, description: Column) -> Column:
    """Complaints about the description, and minor style remarks without a serious word."""
    text = F.lower(F.coalesce(description, F.lit("")))
    minor = (severity == "low") & F.lower(F.coalesce(kind, F.lit(""))).isin(*MINOR_TYPES) & ~text.rlike(RESCUE_WORDS)
    return text.rlike(DESCRIPTION_NOISE) | F.coalesce(minor, F.lit(False))


def counts_for_risk(path: Column, severity: Column, description: Column, explanation: Column) -> Column:
    """On schema, configuration, prompt and template files serious severities need wording of a break."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    soft = low(path).rlike(GENERATED_PATHS)
    breaks = low(explanation).rlike("will break|crash|fail") | low(description).contains("break")
    serious = F.coalesce(severity.isin("critical", "high"), F.lit(False))
    return F.when(soft, breaks | ~serious).otherwise(True)


# What a prompt shows of a request.
PROMPT_FILES, PROMPT_LINES, PROMPT_CHARS, PROMPT_ISSUES, CONTEXT_FILES = 15, 500, 2000, 10, 3


def prompt_files(files: DataFrame, key: str = "pr_number", patch: Column | None = None) -> DataFrame:
    """(key, file_path, rank, patch): the first files of each request, their patches cut by lines and then by signs.

    ``patch`` is the column of that name, cut before files are ranked, or what makes the patch out of other columns. Then only
    these are moved and sorted, and the patches are made of the files that are shown."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("file_path"))
    cut = lambda text: F.substring(F.array_join(F.slice(F.split(text, "\n", -1), 1, PROMPT_LINES), "\n"), 1, PROMPT_CHARS)
    shown = F.col("patch") if patch is None else cut(patch)
    rows = with_patch(files).withColumn("patch", cut(F.col("patch"))) if patch is None else files.where(F.length(F.coalesce(patch, F.lit(""))) > 0)
    return rows.withColumn("rank", rank).where(F.col("rank") <= PROMPT_FILES).select(key, "file_path", "rank", shown.alias("patch"))


def context_query(files: DataFrame, title: str = "title", key: str = "pr_number") -> DataFrame:
    """(key, query): the title and the names of the first files, to look for context with."""
    first = F.slice(F.sort_array(F.collect_list("file_path")), 1, CONTEXT_FILES)
    return files.groupBy(key).agg(F.concat_ws(" ", F.first(title), F.array_join(first, " ")).alias("query"))


def with_patch(files: DataFrame) -> DataFrame:
    return files.where(F.length(F.coalesce("patch", F.lit(""))) > 0)


def size_totals(files: DataFrame, key: str = "pr_number") -> DataFrame:
    """(key, files, additions, deletions, changes, critical_files)."""
    totals = files.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.coalesce("additions", F.lit(0))).cast("long").alias("additions"),
        F.sum(F.coalesce("deletions", F.lit(0))).cast("long").alias("deletions"),
        F.count_if(is_critical_path(F.col("file_path"))).alias("critical_files"),
    )
    return totals.withColumn("changes", F.col("additions") + F.col("deletions"))


def severity_counts(issues: DataFrame, key: str = "pr_number") -> DataFrame:
    return issues.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])


def issue_points(issues: DataFrame, key: str = "pr_number") -> DataFrame:
    """(key, counted, critical, high, other_high, medium, points) of the issues that count for the risk."""
    kept = issues.where(counts_for_risk(F.col("file"), F.col("severity"), F.col("description"), F.col("explanation")))
    breaking = F.coalesce(F.col("type").isin(*BREAKING_TYPES), F.lit(False))
    n = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("counted"),
        F.count_if((F.col("severity") == "critical") & breaking).alias("critical"),
        F.count_if((F.col("severity") == "high") & breaking).alias("high"),
        F.count_if((F.col("severity") == "high") & ~breaking).alias("other_high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
    )
    one = lambda c, p: F.when(F.col(c) > 0, p).otherwise(0)
    points = one("critical", 30) + one("high", 15) + one("other_high", 8) + one("medium", 3) + F.when(F.col("counted") > 15, 3).otherwise(0)
    return n.withColumn("points", points)


def risk(files: DataFrame, issues: DataFrame, key: str = "pr_number") -> DataFrame:
    """(key, files, changes, deletions, score, level, factors, explanation). The level is cut before the score is capped at 100."""
    j = size_totals(files, key).join(issue_points(issues, key), key, "left").na.fill(0, ["counted", "critical", "high", "other_high", "medium", "points"])
    c = F.col
    raw = above(c("files"), FILE_POINTS) + above(c("changes"), LINE_POINTS) + F.when(c("critical_files") > 0, 20).otherwise(0) + above(c("deletions"), DELETION_POINTS) + c("points")

    def said(value: str, options: tuple[tuple[int, str], ...]) -> Column:
        out = None
        for bound, text in options:
            words = F.format_string(text, c(value))
            out = F.when(c(value) > bound, words) if out is None else out.when(c(value) > bound, words)
        return out

    factors = F.array_compact(
        F.array(
            said("files", ((20, "Very large number of files changed (%d)"), (10, "Large number of files changed (%d)"), (5, "Multiple files changed (%d)"))),
            said("changes", ((2000, "Very large changes (%d lines)"), (1000, "Large changes (%d lines)"), (500, "Moderate changes (%d lines)"))),
            said("critical_files", ((0, "Critical infrastructure files modified (%d)"),)),
            said("deletions", ((500, "Very significant deletions (%d lines)"), (200, "Significant deletions (%d lines)"))),
            said("critical", ((0, "%d critical breaking issue(s) detected"),)),
            said("high", ((0, "%d high-severity breaking issue(s) detected"),)),
            said("other_high", ((0, "%d high-severity issue(s) detected"),)),
            said("medium", ((0, "%d medium-severity issue(s) detected"),)),
            said("counted", ((15, "Many issues detected (%d total)"),)),
        )
    )
    j = j.withColumn("raw", raw).withColumn("level", level(c("raw"))).withColumn("factors", factors)
    opening = F.create_map(*[F.lit(x) for pair in OPENINGS.items() for x in pair])[c("level")]
    closing = F.when(F.size("factors") > 0, F.concat(F.lit("Consider: "), F.array_join(F.slice("factors", 1, 2), "; "))).when(c("level").isin("low", "medium"), "Changes appear safe to merge.").otherwise("Review recommended before merging.")
    return j.select(key, "files", "changes", "deletions", F.least("raw", F.lit(100)).cast("long").alias("score"), "level", F.array_join("factors", "; ").alias("factors"), F.concat(opening, closing).alias("explanation"))


def diff_lines(patches: DataFrame, *key: str) -> DataFrame:
    """(key…, pos, hunk, sign, new_line, text): each line of a unified diff with its number in the new file.

    The hunk is a running count of headers; the new line is the hunk's start plus the lines before that are not
    removals. Removed lines, headers and `\\ No newline` marks have none.
    """
    rows = patches.select(*key, F.posexplode(F.split("patch", "\n")).alias("pos", "line"))
    header = F.col("line").startswith("@@")
    by_file = Window.partitionBy(*key).orderBy("pos")
    rows = rows.withColumn("hunk", F.sum(header.cast("int")).over(by_file)).where("hunk > 0")
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int")
    sign = F.when(header, "@").otherwise(F.when(F.col("line").startswith("\\"), "\\").otherwise(F.when(F.col("line") == "", " ").otherwise(F.substring("line", 1, 1))))
    rows = rows.withColumn("sign", sign)
    in_hunk = Window.partitionBy(*key, "hunk").orderBy("pos")
    counted = F.sum(F.col("sign").isin("+", " ").cast("int")).over(in_hunk)
    first = F.first(F.when(header, start)).over(in_hunk)
    new_line = F.when(F.col("sign").isin("+", " "), first + counted - 1)
    return rows.select(*key, "pos", "hunk", "sign", new_line.alias("new_line"), F.expr("substring(line, 2)").alias("text")).where("sign != '@'")


# Begins of lines that are no part of a hunk.
FILE_HEADERS = ("diff --git", "index ", "--- a/", "+++ b/")


def _begins(line: Column, *heads: str) -> Column:
    return reduce(Column.__or__, [line.startswith(h) for h in heads])


def _place_of_line(lines: Column, target: Column) -> Column:
    """Place of the line that is number ``target`` of the new file, counted within hunks that can reach it; -1 for none.

    A hunk can reach up to 20 lines behind its stated length. Empty lines, removals and ``\\`` marks are not counted."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(False).alias("on"), F.lit(-1).alias("at"))

    def step(s: Column, line: Column) -> Column:
        head = line.startswith("@@")
        number = lambda g: F.regexp_extract(line, r"\+([0-9]+)(?:,([0-9]+))?", g)
        begins = head & (number(1) != "")
        first, length = number(1).try_cast("int"), F.coalesce(number(2).try_cast("int"), F.lit(0))
        on = F.when(begins, F.coalesce(target.between(first, first + length + 20), F.lit(False))).otherwise(s["on"])
        counts = s["on"] & ~head & ~_begins(line, *FILE_HEADERS) & (line != "") & ~line.startswith("\\") & (~line.startswith("-") | line.startswith("---"))
        n = F.when(begins & on, first - 1).when(counts, s["n"] + 1).otherwise(s["n"])
        at = F.when((s["at"] < 0) & counts & (n == target), s["i"]).otherwise(s["at"])
        return F.struct((s["i"] + 1).alias("i"), F.coalesce(n, s["n"]).alias("n"), on.alias("on"), at.alias("at"))

    return F.aggregate(lines, state, step, lambda s: s["at"])


def diff_snippet(patches: DataFrame, wanted: DataFrame, *key: str, context: int = 5) -> DataFrame:
    """(key…, target, snippet): what a patch shows around a line of the new file.

    These are the lines up to ``context`` before and behind it as they stand in the patch, at most 25, without blank lines
    and headers. Where the patch does not have the line, it is what stands around its first hunk header, at most 20
    lines; where it has no hunk either, or there is no patch, the snippet is empty. One row per wanted line; a patch is one value, so
    its lines stay in it."""
    j = wanted.join(patches, list(key), "left").withColumn("_l", F.split(F.coalesce("patch", F.lit("")), "\n"))
    bare = lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")
    shown = lambda lines, most, *heads: F.slice(F.filter(lines, lambda x: (bare(x) != "") & ~_begins(bare(x), *heads)), 1, most)
    around = lambda at, before, behind: F.slice("_l", F.greatest(at - before, F.lit(0)) + 1, at + behind - F.greatest(at - before, F.lit(0)))
    j = j.withColumn("_at", _place_of_line(F.col("_l"), F.col("target")))
    j = j.withColumn("_first", F.coalesce(F.array_position(F.transform("_l", lambda x: x.startswith("@@")), F.lit(True)).cast("int"), F.lit(0)) - 1)
    near = F.when(F.col("_at") >= 0, shown(around(F.col("_at"), context, context + 1), 25, *FILE_HEADERS, "@@"))
    hunk = F.when(F.col("_first") >= 0, shown(around(F.col("_first"), 2, 15), 20, *FILE_HEADERS))
    lines = F.when(F.size(near) > 0, near).when(F.size(hunk) > 0, hunk).otherwise(F.array().cast("array<string>"))
    return j.select(*key, "target", F.array_join(lines, "\n").alias("snippet"))
