"""Texts put together for readers and generators: titles, summaries, chunk listings, query texts, sample signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import capped, repo_label

# Sample arguments by what a parameter's name contains, in this order.
SAMPLES = (
    (("id", "key"), "'example_id'"),
    (("data", "input"), "data"),
    (("config", "options"), "None"),
    (("callback", "handler"), "callback"),
    (("count", "num", "size"), "5"),
    (("flag", "enable", "is_"), "True"),
)
#: kind: (field of the first list, its singular names, field of the second list, whether the second is counted)
DIAGRAM_PARTS = {
    "class": ("Classes", "classes", ("className", "id"), "Relationships", "relationships", None),
    "sequence": ("Lifelines", "lifelines", ("name", "id"), "Messages", "messages", None),
    "use_case": ("Actors", "actors", ("name", "id"), "Use cases", "useCases", ("name", "id")),
    "state": ("States", "states", ("label", "id"), "Transitions", "transitions", None),
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(c: Column) -> Column:
    return F.when(_text(c) != "", c)


def document_title(title: Column, description: Column, prompt: Column) -> Column:
    """The first section's title up to 100 signs, else the first sentence of its description, else the prompt's start."""
    sentence = F.trim(F.split(F.trim(_text(description)), r"[.!?]\s+")[0])
    cut = F.trim(F.substring(prompt, 1, 60))
    asked = F.when(F.length(cut) < F.length(prompt), F.concat(cut, F.lit("..."))).otherwise(cut)
    return F.coalesce(F.when(F.length(_text(title)).between(1, 100), title), _filled(F.substring(sentence, 1, 100)), F.when(_text(prompt) != "", asked), F.lit("Documentation"))


def diagram_summary(kind: str, data: Column) -> Column:
    """What a diagram holds, in one line; ``data`` is a struct of the kind's lists."""
    if kind not in DIAGRAM_PARTS:
        return F.lit("UML diagram.")
    one, first, names, two, second, other = DIAGRAM_PARTS[kind]

    def listed(field: str, keys: tuple[str, ...]) -> Column:
        shown = F.transform(data[field], lambda x: F.coalesce(*[_filled(x[k]) for k in keys]))
        return _text(F.array_join(F.array_compact(shown), ", "))

    tail = listed(second, other) if other else F.coalesce(F.size(data[second]), F.lit(0)).cast("string")
    return F.concat(F.lit(f"{one}: "), listed(first, names), F.lit(f". {two}: "), tail, F.lit("."))


def listed_chunk(n: Column, collection: Column, path: Column, kind: Column, klass: Column, function: Column, start: Column, end: Column, content: Column) -> Column:
    """A numbered chunk under a header of its repository, file, kind, names and lines."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    head = F.concat_ws(
        " | ",
        F.concat(F.lit("--- Chunk "), n.cast("string")),
        F.concat(F.lit("repo: "), repo_label(collection)),
        F.concat(F.lit("file: "), F.coalesce(path, F.lit("unknown"))),
        F.concat(F.lit("type: "), _filled(kind)),
        F.concat(F.lit("class: "), _filled(klass)),
        F.concat(F.lit("function: "), _filled(function)),
        F.concat(F.lit("lines: "), known(start), F.lit("-"), known(end), F.lit(" ---")),
    )
    return F.concat(head, F.lit("\n"), _text(content))


def labelled_chunk(path: Column, klass: Column, function: Column, summary: Column, content: Column, most: int = 1200) -> Column:
    """A chunk as labelled lines, the content cut at ``most`` signs."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), _text(path)),
        F.concat(F.lit("Class: "), _filled(klass)),
        F.concat(F.lit("Function: "), _filled(function)),
        F.concat(F.lit("Summary: "), _filled(F.trim(summary))),
        F.lit("Content:"),
        F.substring(_text(content), 1, most),
    )


def contributor_line(name: Column, login: Column, contributions: Column, repo: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(" (@"), login, F.lit(") — "), contributions, F.lit(" commits to "), repo)


def task_query(title: Column, description: Column, kind: Column) -> Column:
    return F.concat(title, _text(F.concat(F.lit(" "), _filled(description))), _text(F.concat(F.lit(" ("), _filled(kind), F.lit(")"))))


def path_query(title: Column, summary: Column, modules: Column) -> Column:
    """Title, summary and the modules' names and summaries in order; ``modules`` is an array of (order, name, summary)."""
    ordered = F.flatten(F.transform(F.array_sort(modules), lambda m: F.array(m["name"], m["summary"])))
    words = F.concat(F.array(title, summary), F.coalesce(ordered, F.array().cast("array<string>")))
    joined = F.trim(F.array_join(F.filter(words, lambda w: _text(w) != ""), " "))
    return F.when(joined == "", "onboarding setup documentation").otherwise(joined)


def without_name(description: Column, name: Column) -> Column:
    """The description without the name and a colon, or the name and `is`, at its start."""
    start = F.concat(F.lit(r"(?i)^\Q"), name)
    cut = F.regexp_replace(description, F.concat(start, F.lit(r"\E[:\s]+")), F.lit(""))
    return F.trim(F.regexp_replace(cut, F.concat(start, F.lit(r"\E\s+is\s+")), F.lit("")))


def module_path(path: Column) -> Column:
    """The folder as dotted names, source roots left out; null for a file at the root."""
    folder = F.regexp_extract(F.translate(path, "\\", "/"), "^(.*)/[^/]*$", 1)
    bare = F.regexp_replace(folder, "app/|src/|lib/", "")
    return F.when(folder != "", F.translate(bare, "/", "."))


def sample_signature(path: Column, name: Column, parameters: Column) -> Column:
    """A call with sample arguments; ``parameters`` is an array of (name, default_value)."""

    def argument(p: Column) -> Column:
        sample = None
        for parts, value in SAMPLES:
            hit = F.lower(p["name"]).rlike("|".join(parts))
            sample = F.when(hit, value) if sample is None else sample.when(hit, value)
        return F.concat(p["name"], F.lit("="), F.coalesce(_filled(p["default_value"]), sample.otherwise("None")))

    arguments = F.coalesce(F.array_join(F.transform(parameters, argument), ", "), F.lit(""))
    return F.concat(F.concat_ws(".", module_path(path), name), F.lit("("), arguments, F.lit(")"))


def capped_node(tree: DataFrame) -> DataFrame:
    """A tree row as it is served: texts and lists cut to what a client shows."""
    sizes = {"description": 400, "details": 400, "purpose": 400, "explanation": 600}
    lists = {"usages": 10, "dependencies": 15, "logic_flow": 10, "api_calls": 10}
    texts = {c: capped(F.col(c), n) for c, n in sizes.items() if c in tree.columns}
    arrays = {c: F.slice(c, 1, n) for c, n in lists.items() if c in tree.columns}
    code = {"code_sample": capped(F.col("code_sample"), 1500, "\n// ... (truncated)")} if "code_sample" in tree.columns else {}
    return tree.withColumns(texts | arrays | code)


def rule_document(role: Column, context: Column, title: Column, body: Column) -> Column:
    """A guide or rule of an agent bundle: front matter, heading, body."""
    head = F.concat_ws("\n", F.lit("----"), F.concat(F.lit("role: "), _filled(role)), F.concat(F.lit("context: "), _filled(F.trim(context))), F.lit("----"))
    return F.concat(head, F.lit("\n\n# "), title, F.lit("\n\n"), F.trim(_text(body)))
