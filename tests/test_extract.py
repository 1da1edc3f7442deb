"""Extractors on a small hand-made repository."""

import random

from tessera.operators import chunks, graph, resolve
from tessera.operators.extract import generated, python_source, scan, script_source

PY = '''"""Module."""
import os
from .util import helper as h

class Base:
    pass

class Shop(Base):
    """Doc."""

    def __init__(self, db: str = "x", *rest):
        self.db = db

    @staticmethod
    async def load(n: int) -> int:
        return h(n)

@app.get("/items")
def items(q):
    return Shop(q).load(1)
'''
JS = """import React, { useState as s } from 'react';
import { a } from './a';
const cfg = { x: 1, y: [2] };
export async function run(x, y = 2, ...rest) { return helper(x); }
export const add = (a: number, b?: string): number => a + b;
class Box extends Base { static make(v) { return new Box(v); } private name = 'q'; }
app.get('/p', (req, res) => { res.send(add(1)); });
export default Box;
"""


def by(rows, **want):
    return [r for r in rows if all(getattr(r, k) == v for k, v in want.items())]


def test_python():
    rows = list(python_source.extract(PY))
    assert {r.name for r in by(rows, kind="function", what="symbol")} == {"__init__", "load", "items"}
    load = by(rows, kind="method", name="load")[0]
    assert load.is_async and load.is_static and load.parent == "Shop" and load.return_type == "int"
    assert by(rows, kind="class", name="Shop")[0].extends == "Base"
    assert by(rows, kind="method", name="__init__")[0].parameters[1] == {"name": "db", "type": "str", "optional": True, "default_value": "'x'"}
    assert by(rows, kind="route")[0].source == "/items" and by(rows, kind="route")[0].receiver == "app"
    assert {(r.source, tuple(r.items)) for r in by(rows, what="import")} == {("os", ("os",)), (".util", ("h",))}
    assert {r.name for r in by(rows, what="call", kind="constructor")} == {"Shop"}


def test_script():
    rows = list(script_source.extract(JS))
    assert {r.name for r in by(rows, kind="function", what="symbol")} == {"run", "add"}
    run = by(rows, kind="function", name="run", what="symbol")[0]
    assert run.is_async and run.is_exported and [p["name"] for p in run.parameters] == ["x", "y", "rest"]
    assert run.parameters[1]["default_value"] == "2"
    add = by(rows, kind="function", name="add", what="symbol")[0]
    assert add.return_type == "number" and add.parameters[1]["optional"]
    assert by(rows, kind="class")[0].extends == "Base"
    assert by(rows, kind="method", name="make")[0].is_static
    assert not by(rows, kind="property", name="name")[0].is_public
    assert {r.name for r in by(rows, kind="constant", what="symbol")} == {"cfg"}
    assert by(rows, kind="route")[0].source == "/p"
    assert by(rows, kind="default_export")
    assert {r.source for r in by(rows, what="import")} == {"react", "./a"}
    assert "Box" in {r.name for r in by(rows, kind="constructor")} and "helper" in {r.name for r in by(rows, what="call")}


def test_tables_and_chunks(spark):
    files = spark.createDataFrame(
        [("src/shop.py", PY, 0), ("src/util.py", "def helper(n):\n    return n\n", 1), ("src/bad.py", "def (", 2), ("node_modules/q.js", JS, 3), ("src/m.go", "package x", 4), ("web/x.ts", JS, 5)],
        "path string, content string, ordinal int",
    )
    rows = scan.found(files).cache()
    assert {r.path for r in scan.errors(rows).collect()} == {"src/bad.py"}
    assert {r.path for r in scan.symbols(rows).select("path").distinct().collect()} == {"src/shop.py", "src/util.py", "web/x.ts"}
    made = chunks.function_chunks(files.where("path like 'src/%'"), scan.symbols(rows).select("path", "kind", "name", "parent", "start_line", "end_line", "ordinal"))
    ids = {r.id: r.content for r in made.collect()}
    assert ids["src/m.go:file"] == "package x" and ids["src/util.py:helper"].startswith("def helper")
    assert "src/shop.py:Shop.load" in ids and any(i.startswith("src/shop.py:route:GET:") for i in ids)
    deps = resolve.call_dependencies(scan.calls(rows).withColumnRenamed("function_name", "function_name"), scan.symbols(rows).where("kind = 'function'"))
    assert deps.count() >= 0


def _flows_one_by_one(functions, calls):
    """Functions in order; a chain is a breadth-first walk over callees in order, and what it meets begins no other."""
    done, chains = set(), {}
    for f in functions:
        if f in done:
            continue
        chain, queue = [f], [f]
        while queue:
            called = {n for s, n in calls if s == queue[0]}
            queue.pop(0)
            new = [g for g in functions if names[g] in called and g not in chain]
            chain += new
            queue += new
        chains[f] = chain
        done |= set(chain)
    return chains


names = {f"p{i}:{n}": n for i, n in enumerate("abcadxyzbwvu")}


def test_flow_chunks_against_walks(spark):
    """Random graphs with cycles, shared names and callers that are no function."""
    rng = random.Random(3)
    ids = list(names)
    for density in (4, 9, 16, 30):
        calls = {(rng.choice([*ids, "p0:unknown"]), rng.choice([*names.values(), "print"])) for _ in range(density)}
        functions = spark.createDataFrame([(i, i.split(":")[0], names[i], f"body {i}", k) for k, i in enumerate(ids)], "id string, path string, name string, content string, place int")
        made = chunks.flow_chunks(functions, spark.createDataFrame(list(calls), "source_id string, name string")).collect()
        want = _flows_one_by_one(ids, calls)
        assert {r.id.removeprefix("flow:"): r.members for r in made} == want
        assert all((r.type == "flow") == (len(r.members) > 1) == r.id.startswith("flow:") for r in made)


def test_flow_and_closure(spark):
    functions = spark.createDataFrame([(i, "p", i, f"body {i}", k) for k, i in enumerate("fghz")], "id string, path string, name string, content string, place int")
    edges = spark.createDataFrame([("f", "g"), ("g", "h"), ("h", "f"), ("z", "z")], "source_id string, target_id string")
    got = {r.id: r for r in chunks.flow_chunks(functions, edges.withColumnRenamed("target_id", "name")).collect()}
    assert set(got) == {"flow:f", "z"}
    assert got["flow:f"].members == ["f", "g", "h"] and got["flow:f"].content.startswith("// p:f\nbody f")
    assert got["z"].type == "function" and got["z"].content == "body z"
    reached = {(r.start, r.node): r.depth for r in graph.closure(edges).collect()}
    assert reached[("f", "h")] == 2 and reached[("f", "f")] == 0


def test_import_resolution(spark):
    files = spark.createDataFrame([("web/y.ts", 0), ("web/dir/index.ts", 1), ("z.tsx", 2), ("web/foobar.ts", 3)], "path string, ordinal int")
    imports = spark.createDataFrame([("web/x.ts", "./y"), ("web/x.ts", "./dir"), ("web/x.ts", "../z"), ("web/x.ts", "react"), ("web/x.ts", "./foo"), ("web/x.ts", "./none")], "from_path string, source string")
    got = {r.source: r.to_path for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {"./y": "web/y.ts", "./dir": "web/dir/index.ts", "../z": "z.tsx", "react": None, "./foo": "web/foobar.ts", "./none": None}


def test_json_repair():
    assert generated.repaired_json('Sure:\n```json\n{"a": [1, 2,],}\n```') == '{"a":[1,2]}'
    assert generated.repaired_json('{"a": "x\ny"}') == '{"a":"x\\ny"}'
    assert generated.repaired_json('{"a": "say "hi" now"}') == '{"a":"say \\"hi\\" now"}'
    assert generated.repaired_json('{"a": [{"b": 1}, {"b": 2}, {"b"') == '{"a":[{"b":1},{"b":2}]}'
    far = '{"a": [' + ", ".join('{"b": [1, 2, {"c": 3}]}' for _ in range(4)) + ', {"d": ' + "[" * 80 + ", ".join("bad" for _ in range(80))
    assert generated.repaired_json(far) == '{"a":[' + ",".join(['{"b":[1,2,{"c":3}]}'] * 4) + "]}"
    assert generated.repaired_json("none") is None and generated.repaired_json(None) is None


def test_signatures_and_docstrings(spark):
    assert generated.signature_parts("def f(self, a: int = 3, b: dict[str, int] = {}, *rest, **kw) -> int") == [("a", "int", "3"), ("b", "dict[str, int]", "{}")]
    assert python_source.without_docstrings('def f():\n    """x"""\n') == "def f():\n    pass\n"
    assert python_source.without_docstrings("def (") == "def ("
    df = spark.createDataFrame([('x\n"""A docstring that is long enough."""',), ("/** short */",)], "c string")
    assert [r.d for r in df.select(generated.docstring(df.c).alias("d")).collect()] == ["A docstring that is long enough.", None]


def test_analysis_graph_and_vectors(spark):

    from tessera.operators import analysis

    files = spark.createDataFrame([("r", "src/shop.py", PY, 0), ("r", "src/util.py", "def helper(n):\n    return n\n", 1), ("r", "web/x.ts", JS, 2), ("r", "web/a.ts", "export function helper(y) { return y; }", 3), ("r", "docs/x.md", "t", 4)], "repo_id string, path string, content string, ordinal int")
    found = analysis.analyze(files)
    deps = {(r.from_path, r.to_path, r.type) for r in found["dependencies"].collect()}
    assert ("web/x.ts", "web/a.ts", "import") in deps and ("src/shop.py", "Base", "extends") in deps and ("web/x.ts", "web/a.ts", "call") in deps
    ids = {r.id for r in found["chunks"].collect()}
    assert any(i.startswith("flow:web/x.ts:run") for i in ids) and "src/shop.py:Shop.load" in ids
    nodes, edges = analysis.build_graph(files, found)
    labels = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    assert labels["File"] == 4 and labels["Folder"] == 2 and labels["Class"] == 3
    kinds = {r["type"] for r in edges.select("type").distinct().collect()}
    assert kinds == {"CONTAINS", "HAS_METHOD", "IMPORTS", "CALLS"}
    known = {r.id for r in nodes.collect()}
    assert all(r.source_id in known and r.target_id in known for r in edges.collect()) and len(known) == nodes.count()
    scored = analysis.scored_graph(nodes, edges)
    assert scored.count() == nodes.count() and scored.where("risk_score between 0 and 1").count() > 0
    points = analysis.vectorize(found["chunks"], "c").collect()
    assert len(points) == len(ids) and all(len(p.vector) == 64 for p in points)


def test_repositories_do_not_mix(spark):
    from tessera.operators import analysis

    one = [("a/x", "m.py", "from .n import f\n\ndef g():\n    return f()\n", 0), ("a/x", "n.py", "def f():\n    return 1\n", 1)]
    two = [("b", "m.py", "def h():\n    return f()\n", 0), ("b", "n.py", "def other():\n    return g()\n", 1)]
    files = spark.createDataFrame(one + two, "repo_id string, path string, content string, ordinal int")
    both, alone = analysis.analyze(files), analysis.analyze(files.where("repo_id = 'a/x'"))
    for name, rows in both.items():
        mine = rows.where("repo_id = 'a/x'").select(sorted(alone[name].columns))
        assert sorted(map(str, mine.collect())) == sorted(map(str, alone[name].select(sorted(alone[name].columns)).collect())), name
    assert {(r.repo_id, r.name, r.defined_in, r.total_calls) for r in both["usage"].collect()} == {("a/x", "f", "n.py", 1), ("a/x", "g", "m.py", 0), ("b", "f", None, 1), ("b", "g", None, 1), ("b", "h", "m.py", 0), ("b", "other", "n.py", 0)}
    assert {(r.repo_id, r.id) for r in both["chunks"].where("type = 'flow'").collect()} == {("a/x", "flow:m.py:g")}
    nodes, edges = analysis.build_graph(files, both, "b")
    assert {r.name for r in nodes.collect()} == {"m.py", "n.py", "h", "other"} and edges.where("type = 'CALLS'").count() == 0
