"""Python files by the standard library's parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from tessera.operators.extract.model import Found, parameter

ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "use")


def _parameters(a: ast.arguments) -> list[dict]:
    positional = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(positional) - len(a.defaults)) + list(a.defaults)
    out = [_parameter(p, d) for p, d in zip(positional, defaults)]
    out += [_parameter(a.vararg, None)] if a.vararg else []
    out += [_parameter(p, d) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
    return out + ([_parameter(a.kwarg, None)] if a.kwarg else [])


def _parameter(p: ast.arg, default: ast.expr | None) -> dict:
    return parameter(p.arg, _dotted(p.annotation) if p.annotation else None, default is not None, ast.unparse(default) if default is not None else None)


def _dotted(e: ast.expr) -> str:
    return e.id if type(e) is ast.Name else ast.unparse(e)


#: Nodes without nodes below them.
_LEAVES = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop, ast.Name, ast.Constant)


def _walked(tree: ast.AST) -> Iterator[ast.AST]:
    """The nodes of ``tree`` in the order of ``ast.walk``, but for those without nodes below them."""
    level = [tree]
    while level:
        below = []
        for node in level:
            for field in node._fields:
                value = getattr(node, field, None)
                if value.__class__ is list:
                    below += [v for v in value if isinstance(v, ast.AST) and not isinstance(v, _LEAVES)]
                elif isinstance(value, ast.AST) and not isinstance(value, _LEAVES):
                    below.append(value)
        yield from level
        level = below


def extract(content: str, what: tuple[str, ...] = ()) -> Iterator[Found | None]:
    """Functions (methods as well), classes with methods, routes, imports, inheritance and calls; those of kinds that ``what`` leaves
    out, if it names any, are None in their places."""
    tree = ast.parse(content)
    symbols, bases, imports, calls = (not what or k in what for k in ("symbol", "inheritance", "import", "call"))
    lines = content.split("\n") if symbols else []

    def function(node: ast.FunctionDef | ast.AsyncFunctionDef, kind: str, parent: str | None) -> Found | None:
        if not symbols:
            return None
        static = any(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod") for d in node.decorator_list)
        body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        return Found("symbol", kind, node.name, parent, node.lineno, node.end_lineno, isinstance(node, ast.AsyncFunctionDef), False, static if parent else None, not node.name.startswith("_"), None, _dotted(node.returns) if node.returns else None, _parameters(node.args), body)

    for node in _walked(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield function(node, "function", None)
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_METHODS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    yield None if not symbols else Found("symbol", "route", d.func.attr.upper(), node.name, node.lineno, node.end_lineno, source=d.args[0].value, receiver=_dotted(d.func.value))
        elif isinstance(node, ast.ClassDef):
            base = next((_dotted(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))), None)
            yield None if not symbols else Found("symbol", "class", node.name, None, node.lineno, node.end_lineno, is_exported=False, extends=base, body="\n".join(lines[node.lineno - 1 : node.end_lineno]))
            if base:
                yield None if not bases else Found("inheritance", "extends", node.name, source=base, start_line=node.lineno)
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield function(m, "method", node.name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield None if not imports else Found("import", "import", source=a.name, items=[a.asname or a.name], start_line=node.lineno)
        elif isinstance(node, ast.ImportFrom):
            yield None if not imports else Found("import", "import", source="." * node.level + (node.module or ""), items=[a.asname or a.name for a in node.names], start_line=node.lineno)
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                kind = "constructor" if node.func.id[:1].isupper() else "function"
                yield None if not calls else Found("call", kind, node.func.id, start_line=node.lineno, column=node.col_offset)
            elif isinstance(node.func, ast.Attribute):
                yield None if not calls else Found("call", "method", node.func.attr, start_line=node.lineno, column=node.col_offset, receiver=_dotted(node.func.value))


def without_docstrings(content: str) -> str:
    """The source with docstrings blanked; unparsable source is returned as it is. A body left empty gets `pass`."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return content
    lines = content.split("\n")
    for node in ast.walk(tree):
        if not isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) or ast.get_docstring(node, clean=False) is None:
            continue
        doc = node.body[0]
        for k in range(doc.lineno - 1, doc.end_lineno):
            raw = lines[k].encode()
            begin = doc.col_offset if k == doc.lineno - 1 else 0
            end = doc.end_col_offset if k == doc.end_lineno - 1 else len(raw)
            gap = "pass" if k == doc.lineno - 1 and len(node.body) == 1 and not isinstance(node, ast.Module) else ""
            lines[k] = (raw[:begin] + gap.encode() + raw[end:]).decode()
    return "\n".join(lines)
