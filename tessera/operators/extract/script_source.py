"""JavaScript and TypeScript files by a tokenizer and bracket matching.

There is no grammar at hand, so declarations are recognised by the tokens they start with and end at their closing
bracket. Strings, templates, comments and regular expressions are stepped over.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from tessera.operators.extract.model import Found, parameter

ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "use")
KEYWORDS = frozenset("if for while switch catch return function typeof new await import require super constructor do else in of instanceof delete void throw yield case with".split())
_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|=>|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Tokens:
    def __init__(self, content: str):
        self.text, self.at, self.content = [], [], content
        for m in _TOKEN.finditer(content):
            if not m[0].startswith(("//", "/*")):
                self.text.append(m[0])
                self.at.append(m.start())
        starts = [0] + [m.end() for m in re.finditer("\n", content)]
        self.line = lambda pos: bisect_right(starts, pos)
        self.column = lambda pos: pos - starts[bisect_right(starts, pos) - 1]
        self.partner = {}
        stack: list[int] = []
        for i, t in enumerate(self.text):
            if t in _CLOSE:
                stack.append(i)
            elif t in (")", "]", "}"):
                while stack and _CLOSE[self.text[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    self.partner[stack.pop()] = i
        self.text += [""] * 8
        self.at += [len(content)] * 8

    def end(self, i: int) -> int:
        """Token after the bracket that opens at ``i``; the last if it never closes."""
        return self.partner.get(i, len(self.text) - 9) + 1

    def between(self, i: int, j: int) -> str:
        return self.content[self.at[i] : self.at[j - 1] + len(self.text[j - 1])]


def _split(t: _Tokens, i: int, j: int) -> list[tuple[int, int]]:
    """Ranges between commas at depth 0 within tokens ``i`` to ``j``; brackets and angle brackets nest."""
    out, begin, depth, k = [], i, 0, i
    while k < j:
        x = t.text[k]
        if x in _CLOSE:
            k = min(t.end(k), j)
            continue
        depth += (x == "<") - (x == ">" and depth > 0)
        if x == "," and depth == 0:
            out.append((begin, k))
            begin = k + 1
        k += 1
    return out + ([(begin, j)] if begin < j else [])


def _parameters(t: _Tokens, open_: int) -> list[dict]:
    out = []
    for i, j in _split(t, open_ + 1, t.end(open_) - 1):
        words = t.text[i:j]
        k = i
        while t.text[k] in (".", "public", "private", "protected", "readonly"):
            k += 1
        stop = t.end(k) if t.text[k] in _CLOSE else k + 1
        name = t.between(k, stop)
        default = next((x for x in range(stop, j) if t.text[x] == "="), None)
        colon = next((x for x in range(stop, default or j) if t.text[x] == ":"), None)
        out.append(parameter(name, t.between(colon + 1, default or j) if colon and colon + 1 < (default or j) else None, "?" in words[stop - i : stop - i + 1] or default is not None, t.between(default + 1, j) if default and default + 1 < j else None))
    return out


def _return_type(t: _Tokens, i: int) -> tuple[str | None, int]:
    """Type after a parameter list and the token of the body's brace or arrow."""
    if t.text[i] != ":":
        return None, i
    k = i + 1
    while t.text[k] not in ("{", "=>", ";", "") or (t.text[k] == "{" and k == i + 1):
        k = t.end(k) if t.text[k] in _CLOSE else k + 1
    return t.between(i + 1, k) if k > i + 1 else None, k


def extract(content: str) -> Iterator[Found]:
    """Functions (also arrows), classes with methods and properties, constants, exports, routes, imports, inheritance, calls."""
    t = _Tokens(content)
    n = len(t.text) - 8

    def symbol(kind: str, name: str, i: int, j: int, **more) -> Found:
        return Found("symbol", kind, name, start_line=t.line(t.at[i]), end_line=t.line(t.at[max(i, j - 1)]), body=t.between(i, max(j, i + 1)), **more)

    def function(i: int, first: int, name: str, open_: int, kind: str = "function", **more) -> tuple[Found, int]:
        returns, body = _return_type(t, t.end(open_))
        if t.text[body] == "=>":
            body += 1
        stop = t.end(body) if t.text[body] == "{" else _statement_end(body)
        return symbol(kind, name, first, stop, is_async="async" in t.text[first:open_], return_type=returns, parameters=_parameters(t, open_), **more), stop

    def _statement_end(i: int) -> int:
        while i < n and t.text[i] not in (";", ")", "}", ","):
            if t.line(t.at[i]) > t.line(t.at[i - 1]) and t.text[i] not in (".", "?", ":", "+", "&", "|") and t.text[i - 1] not in ("=>", "(", "+", "&", "|", "?", ":", "="):
                break
            i = t.end(i) if t.text[i] in _CLOSE else i + 1
        return max(i, 1)

    i = 0
    while i < n:
        x = t.text[i]
        first = i
        exported = x == "export"
        if exported:
            if t.text[i + 1] == "default":
                stop = _statement_end(i + 2)
                yield symbol("default_export", t.text[i + 2] if re.match(r"[A-Za-z_$]", t.text[i + 2]) else "default", i, stop)
                yield Found("export", "default", t.text[i + 2], start_line=t.line(t.at[i]))
                i += 1
            elif t.text[i + 1] == "{":
                for a, b in _split(t, i + 2, t.end(i + 1) - 1):
                    yield Found("export", "named", t.text[b - 1], start_line=t.line(t.at[i]))
                i = t.end(i + 1)
                continue
            i += 1
            while t.text[i] in ("abstract", "declare"):
                i += 1
            x = t.text[i]
        if x == "async" and t.text[i + 1] == "function":
            i += 1
            x = "function"
        if x == "function" and re.match(r"[A-Za-z_$]", t.text[i + 1] if t.text[i + 1] != "*" else t.text[i + 2]):
            k = i + 1 + (t.text[i + 1] == "*")
            name, k = t.text[k], k + 1
            while k < n and t.text[k] != "(":
                k += 1
            found, _ = function(i, first, name, k, is_exported=exported)
            yield found
            if exported:
                yield Found("export", "function", name, start_line=found.start_line)
            i = k + 1
            continue
        if x == "class" and re.match(r"[A-Za-z_$]", t.text[i + 1]):
            yield from _class(t, i, first, exported, symbol, function)
            k = i + 2
            while k < n and t.text[k] != "{":
                k += 1
            i = k + 1
            continue
        if x in ("const", "let", "var") and re.match(r"[A-Za-z_$]", t.text[i + 1]):
            name, k = t.text[i + 1], i + 2
            if t.text[k] == ":":
                while k < n and t.text[k] not in ("=", ";"):
                    k = t.end(k) if t.text[k] in _CLOSE else k + 1
            if t.text[k] == "=":
                v = k + 1 + (t.text[k + 1] == "async")
                if t.text[v] == "function":
                    o = next((q for q in range(v, min(v + 4, n)) if t.text[q] == "("), None)
                    if o is not None:
                        yield function(i, first, name, o, is_exported=exported)[0]
                elif t.text[v] == "(" and _arrow(t, v):
                    yield function(i, first, name, v, is_exported=exported)[0]
                elif t.text[v + 1] == "=>" and re.match(r"[A-Za-z_$]", t.text[v]):
                    body = v + 2
                    stop = t.end(body) if t.text[body] == "{" else _statement_end(body)
                    yield symbol("function", name, first, stop, is_async=t.text[k + 1] == "async", is_exported=exported, parameters=[parameter(t.text[v])])
                elif t.text[v] in ("{", "["):
                    yield symbol("constant", name, first, t.end(v), is_exported=exported)
                elif t.text[v] == "require" and t.text[v + 1] == "(":
                    yield Found("import", "require", source=t.text[v + 2][1:-1], items=[name], start_line=t.line(t.at[i]))
            if exported:
                yield Found("export", "constant", name, start_line=t.line(t.at[i]))
            i += 2
            continue
        if x == "import" and t.text[i + 1] != "(":
            k = i + 1
            while k < n and t.text[k][:1] not in "\"'":
                k += 1
            if k < n:
                words = [w for w in t.text[i + 1 : k] if re.match(r"[A-Za-z_$]", w) and w not in ("from", "as", "type")]
                yield Found("import", "type" if t.text[i + 1] == "type" else "import", source=t.text[k][1:-1], items=words or ["*"], start_line=t.line(t.at[i]))
            i = k + 1
            continue
        if t.text[i + 1] == "(" and re.match(r"[A-Za-z_$]", x) and x not in KEYWORDS and not (t.end(i + 1) < n and t.text[t.end(i + 1)] == "{" and t.text[i - 1] in ("{", "}", ";") and t.text[i - 1] != ""):
            dot = i > 0 and t.text[i - 1] == "."
            new = i > 0 and t.text[i - 1] == "new"
            yield Found("call", "constructor" if new else "method" if dot else "function", x, start_line=t.line(t.at[i]), column=t.column(t.at[i]), receiver=t.text[i - 2] if dot and i > 1 else None)
            if dot and x in ROUTE_METHODS and t.text[i + 2][:1] in ("'", '"', "`"):
                yield Found("symbol", "route", x.upper(), start_line=t.line(t.at[i]), end_line=t.line(t.at[t.end(i + 1) - 1]), source=t.text[i + 2][1:-1], receiver=t.text[i - 2])
        i += 1


def _arrow(t: _Tokens, open_: int) -> bool:
    return t.text[_return_type(t, t.end(open_))[1]] == "=>"


def _class(t: _Tokens, i: int, first: int, exported: bool, symbol, function) -> Iterator[Found]:
    name, k, base = t.text[i + 1], i + 2, None
    while t.text[k] not in ("{", ""):
        if t.text[k] == "extends":
            base = t.text[k + 1]
        k += 1
    stop = t.end(k)
    yield symbol("class", name, first, stop, is_exported=exported, extends=base)
    if exported:
        yield Found("export", "class", name, start_line=t.line(t.at[i]))
    if base:
        yield Found("inheritance", "extends", name, source=base, start_line=t.line(t.at[i]))
    m = k + 1
    while m < stop - 1:
        start, flags = m, set()
        while t.text[m] in ("public", "private", "protected", "static", "async", "readonly", "get", "set", "*", "#") and t.text[m + 1] not in ("(", "=", ":", ";"):
            flags.add(t.text[m])
            m += 1
        if re.match(r"[A-Za-z_$]", t.text[m]):
            o = m + 1
            if t.text[o] == "<":
                while t.text[o] not in ("(", ""):
                    o += 1
            public = not flags & {"private", "protected", "#"}
            if t.text[o] == "(":
                found, m = function(m, start, t.text[m], o, "method", parent=name, is_static="static" in flags, is_public=public)
                yield found
                continue
            yield Found("symbol", "property", t.text[m], name, t.line(t.at[start]), t.line(t.at[m]), is_static="static" in flags, is_public=public)
            while m < stop - 1 and t.text[m] != ";" and t.line(t.at[m + 1]) == t.line(t.at[m]):
                m = t.end(m) if t.text[m] in _CLOSE else m + 1
        m += 1
