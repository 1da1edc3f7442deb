"""Scalar functions on names, paths and short texts. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def sanitize_name(name: Column) -> Column:
    """Letters and digits in lower case, everything else one underscore, none at the ends."""
    joined = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]+", "_")
    return F.lower(F.regexp_replace(joined, "^_|_$", ""))


def collection_name(organization: Column, short_id: Column, repository: Column, branch: Column) -> Column:
    """`org_slug_repo_branch`, the branch as it is; null where slug or repository is missing or empty."""
    known = (F.coalesce(short_id, F.lit("")) != "") & (F.coalesce(repository, F.lit("")) != "")
    org = F.when(F.coalesce(organization, F.lit("")) == "", short_id).otherwise(organization)
    return F.when(known, F.concat_ws("_", sanitize_name(org), sanitize_name(short_id), sanitize_name(repository), branch))


def repo_token(name: Column, strict: bool = True) -> Column:
    """Canonical form a repository is asked for by. ``strict`` replaces any other sign by an underscore too."""
    cleaned = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "-/.", "___")
    if strict:
        cleaned = F.regexp_replace(cleaned, r"[^\p{L}\p{N}_]", "_")
    return F.regexp_replace(F.regexp_replace(cleaned, "_+", "_"), "^_|_$", "")


def repo_slug(collection: Column) -> Column:
    """Repository part of a collection name: what stands between the second and the last underscore."""
    parts = F.split(F.coalesce(collection, F.lit("")), "_")
    middle = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "_")
    return F.lower(F.when(F.size(parts) > 3, middle).when(F.size(parts) == 3, parts[2]).otherwise(collection))


def repo_label(collection: Column) -> Column:
    """The same part for display: hyphens for underscores, case kept."""
    parts = F.split(F.coalesce(collection, F.lit("")), "_")
    middle = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "-")
    return F.when(F.size(parts) > 3, middle).when(F.size(parts) == 3, parts[2]).otherwise(collection)


def content_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by colons."""
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16)


def uuid5(name: Column) -> Column:
    """UUID version 5 in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def title_case(text: Column) -> Column:
    """Every run of letters begins with a capital, also after digits and hyphens."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def slug(prefix: str, prompt: Column) -> Column:
    """`prefix-` and the first 60 characters as lower-case words joined by hyphens, `diagram` if none is left."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.substring(F.trim(prompt), 1, 60)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.coalesce(words, F.lit("")) == "", "diagram").otherwise(words))


def capped(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def chat_title(message: Column) -> Column:
    return capped(F.trim(message), 36, "…")


def fenced_json(text: Column) -> Column:
    """The object in a fenced block, else from the first to the last brace; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def identifier_words(name: Column) -> Column:
    """Words of camel-case, acronym and digit runs, lower case, longer than two signs."""
    parts = F.regexp_extract_all(name, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+"), F.lit(0))
    return F.filter(F.transform(parts, F.lower), lambda w: F.length(w) > 2)


def lines_between(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1, both included and clamped to the content."""
    lines = F.split(content, "\r\n|\n|\r", -1)
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first.cast("int"), F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0)).cast("int")), "\n")


def embedding_text(function: Column, klass: Column, path: Column, subsystem: Column, calls: Column, dependencies: Column, summary: Column, keywords: Column, content: Column) -> Column:
    """Labelled context parts joined by ` | `, a blank line, the content. Missing parts are left out."""

    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    context = F.concat_ws(
        " | ",
        part("Function", function),
        part("Class", klass),
        part("File", path),
        part("Subsystem", subsystem),
        part("Calls", F.array_join(calls, ", ")),
        part("Dependencies", F.array_join(F.slice(dependencies, 1, 5), ", ")),
        part("Summary", summary),
        part("Keywords", F.array_join(keywords, ", ")),
    )
    return F.concat(context, F.lit("\n\n"), F.coalesce(content, F.lit("")))


def masked_url(url: Column) -> Column:
    """A connection address without its password."""
    return F.regexp_replace(url, r"(://[^:/@]*:)[^@]*@", "$1***@")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def object_key(prefix: str, *parts: Column) -> Column:
    """Storage key: the parts joined by slashes, slashes inside a part as underscores."""
    return F.concat_ws("/", F.lit(prefix), *[F.translate(p, "/", "_") for p in parts])


def normal_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(title)), r"\s+", " ")


def cleaned_comment(text: Column) -> Column:
    """A review comment without emoji and markdown marks, blank runs shortened."""
    steps = ((r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", ""), (r"(?s)```.*?```", ""), (r"`([^`]*)`", "$1"), (r"\*\*([^*]*)\*\*", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*]\s+", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)
