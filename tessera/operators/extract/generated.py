"""Texts a generator wrote: JSON that is nearly right, signatures, docstrings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def repaired_json(raw: str | None) -> str | None:
    """Compact JSON of the object or list in ``raw``, or null.

    Tried in turn: as it is, without control signs and trailing commas, with raw newlines and inner quotes of
    strings escaped, and cut back to the last complete value with its brackets closed.
    """
    if not raw:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S)
    text = (fenced[1] if fenced else raw).strip()
    opening = [k for k in (text.find("{"), text.find("[")) if k >= 0]
    if not opening:
        return None
    text = text[min(opening) :]
    closed = text[: max(text.rfind("}"), text.rfind("]")) + 1]
    tidy = re.sub(r",\s*([}\]])", r"\1", _CONTROL.sub("", closed or text))
    for attempt in (closed, tidy, _escaped(tidy), *_cut_back(_escaped(_CONTROL.sub("", text)))):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            continue
    return None


_CLOSES = re.compile(r"\s*(?:[,:}\]]|$)")


def _escaped(text: str) -> str:
    """Raw line breaks inside strings escaped, and quotes that no separator follows."""
    out, inside, k = [], False, 0
    while k < len(text):
        c = text[k]
        if inside and c == "\\":
            out.append(text[k : k + 2])
            k += 2
            continue
        if c == '"':
            if not inside:
                inside = True
            elif _CLOSES.match(text, k + 1):
                inside = False
            else:
                c = '\\"'
        elif inside and c in "\r\n\t":
            c = {"\r": "\\r", "\n": "\\n", "\t": "\\t"}[c]
        out.append(c)
        k += 1
    return "".join(out)


def _cut_back(text: str) -> Iterator[str]:
    """Prefixes that end with a value, brackets closed, longest first."""
    stack, inside, k, ends = [], False, 0, []
    while k < len(text):
        c = text[k]
        if inside:
            if c == "\\":
                k += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            ends.append((k + 1, tuple(stack)))
        elif c == ",":
            ends.append((k, tuple(stack)))
        k += 1
    # the brackets open there are those of a prefix, so they are put together only when asked for
    return (text[:at] + "".join(reversed(closing)) for at, closing in reversed(ends))


def repair_json(raw: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired_json, na_action="ignore")

    return run(raw)


def docstring(code: Column, most: int = 800) -> Column:
    """The first block comment or docstring of more than 20 signs, without comment marks; null if there is none."""
    found = [F.regexp_replace(F.regexp_replace(F.regexp_extract(code, p, 1), r"(?m)^\s*\*\s?", ""), r"^\s+|\s+$", "") for p in (r"(?s)/\*\*(.*?)\*/", r'(?s)"""(.*?)"""', r"(?s)'''(.*?)'''")]
    return F.substring(F.coalesce(*[F.when(F.length(f) > 20, f) for f in found]), 1, most)


def signature_parts(signature: str | None) -> list[tuple[str, str | None, str | None]]:
    """(name, type, default) of the parameters in the first brackets; rest markers and receivers are left out."""
    m = re.search(r"\(", signature or "")
    if not m:
        return []
    depth, begin, parts = 0, m.end(), []
    for k in range(m.start(), len(signature)):
        c = signature[k]
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and signature[k - 1] != "="))
        if depth == 0 or (c == "," and depth == 1):
            parts.append(signature[begin:k])
            begin = k + 1
        if depth == 0:
            break
    out = []
    for p in (p.strip() for p in parts):
        name, _, default = p.partition("=")
        name, _, kind = name.partition(":")
        name = name.strip().rstrip("?")
        if name and name not in ("self", "cls", "*", "/") and not name.startswith(("*", "...")):
            out.append((name, kind.strip() or None, default.strip() or None))
    return out


def snippet(content: Column, start: Column, end: Column, name: Column) -> Column:
    """Lines ``start`` to ``end`` if there are any, else from the definition of ``name`` on, else the first 5000 signs."""
    from tessera.functions.text import lines_between

    cut = lines_between(content, start, end)
    defined = F.regexp_extract(content, r"(?s)((?:async\s+)?(?:def|function|class)\s+.*)", 1)
    named = F.when(F.contains(defined, name), defined)
    return F.coalesce(F.when(F.trim(cut) != "", cut), F.when(named != "", F.substring(named, 1, 5000)), F.substring(content, 1, 5000))
