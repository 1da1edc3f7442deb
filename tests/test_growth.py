"""Plans that must cost the sum of their inputs, whatever the input's files, and whose ties go by keys."""

from pyspark.sql import functions as F

from tessera.operators import analysis, graph, resolve, summaries
from tessera.operators.extract import scan



def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.range(0, 400, 1, 1).select(F.format_string("a/m%d.py", "id").alias("path"), F.lit("def f():\n    g()\n").alias("content"))
    found = scan.found(files)
    assert found.count() == 800
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4



def test_kinds_that_are_asked_for_keep_their_ordinals(spark):
    files = spark.createDataFrame([("a.py", "import os\ndef f():\n    g()\n"), ("b.py", "def (\n")], "path string, content string")
    whole = {tuple(r) for r in scan.found(files).where("what in ('call', 'error')").select("path", "what", "name", "ordinal").collect()}
    assert {tuple(r) for r in scan.found(files, "call").select("path", "what", "name", "ordinal").collect()} == whole



def test_of_equal_names_the_last_file_defines(spark):
    files = spark.createDataFrame([(f"a/m{k}.py", "def f():\n    pass\n", k, "r") for k in (3, 9, 1, 7, 5)], "path string, content string, ordinal long, repo_id string")
    (row,) = analysis.analyze(files.repartition(5), "function")["usage"].collect()
    assert row["defined_in"] == "a/m9.py"



def test_joins_with_made_texts_broadcast_none(spark):
    """A chunk's file is text that a plan makes of small columns; by their estimated size it would be sent to the driver whole."""
    files = spark.range(0, 50, 1, 1).select(F.format_string("a/m%d.py", "id").alias("path"), F.concat(F.lit("def f():\n    pass\n"), F.repeat(F.lit("# text\n"), 100)).alias("content"), F.col("id").alias("ordinal"), F.lit("r").alias("repo_id"))
    made = analysis.analyze(files, "function")["chunks"]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert made.count() == 50 and "Broadcast" not in plan



def test_imports_meet_a_folder_once(spark):
    """Two thousand files and imports in one folder: far fewer rows than pairs."""
    files = spark.range(2000).select(F.format_string("a/m%d.ts", "id").alias("path"), F.col("id").alias("ordinal"))
    imports = spark.range(2000).select(F.format_string("a/x%d.ts", "id").alias("from_path"), F.format_string("./m%d", (F.col("id") + 1) % 2100).alias("source"))
    found = resolve.resolve_imports(imports, files)
    rows = {r["source"]: r["to_path"] for r in found.collect()}
    assert len(rows) == 2000 and rows["./m1999"] == "a/m1999.ts" and rows["./m2"] == "a/m2.ts" and rows["./m2000"] is None
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "startswith(to_path" not in plan.lower()



def test_a_beginning_means_the_first_file(spark):
    files = spark.createDataFrame([("a/util.go", 5), ("a/utility.ts", 2), ("a/util/deep/x.ts", 1), ("b/y.ts", 3)], "path string, ordinal long")
    imports = spark.createDataFrame([("a/x.ts", "./util"), ("a/x.ts", "../b"), ("a/x.ts", "./none"), ("a/x.ts", "react")], "from_path string, source string")
    got = {r["source"]: r["to_path"] for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {"./util": "a/util/deep/x.ts", "../b": "b/y.ts", "./none": None, "react": None}



def test_summaries_take_one_pass(spark):
    source = "class A:\n    def m(self, x):\n        pass\nclass B:\n    pass\ndef f():\n    pass\n"
    files = spark.createDataFrame([("a.py", source), ("b.py", "class C:\n    pass\n"), ("c.py", "x = 1\n")], "path string, content string")
    rows = summaries.symbol_summary(scan.symbols(scan.found(files)))
    got = {r["path"]: r for r in rows.collect()}
    assert set(got) == {"a.py", "b.py"}
    assert [(c["name"], c["methods"] and [m["name"] for m in c["methods"]]) for c in got["a.py"]["classes"]] == [("A", ["m"]), ("B", None)]
    assert got["b.py"]["functions"] is None and {f["name"] for f in got["a.py"]["functions"]} == {"f", "m"}
    assert rows._jdf.queryExecution().sparkPlan().toString().count("MapInPandas") == 1



def test_batches_of_files_with_equally_many_symbols(spark):
    rows = spark.range(0, 1000, 1, 3).select(F.format_string("m%03d.py", "id").alias("path"), F.lit("python").alias("language"), F.lit("x").alias("source"), F.array().cast("array<string>").alias("symbols"), F.when(F.col("id") == 500, 1).otherwise(0).alias("children"))
    paths = F.transform(F.from_json("files", "array<struct<path:string>>"), lambda f: f["path"])
    got = {r["batch"]: r["p"] for r in summaries.enrichment_batches(rows).select("batch", paths.alias("p")).collect()}
    order = ["m500.py", *[f"m{k:03d}.py" for k in range(1000) if k != 500]]
    assert got == {k: order[3 * k : 3 * k + 3] for k in range(334)}
    assert "windowspecdefinition(children" not in summaries.enrichment_batches(rows)._jdf.queryExecution().toString()



def test_patches_are_made_of_the_files_that_are_shown(spark):
    from tessera.operators import pr

    files = spark.range(0, 40, 1, 2).select((F.col("id") % 2).alias("pr_number"), F.format_string("f%02d", "id").alias("file_path"), F.col("id").cast("int").alias("lines"))
    patch = F.repeat(F.lit("+l\n"), F.col("lines"))
    made = pr.prompt_files(files, patch=patch)
    same = pr.prompt_files(files.withColumn("patch", patch))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, same.collect())) and made.count() == 30
    below = made._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert not [line for line in below.splitlines() if "Project" in line and "repeat(" in line]



def test_a_round_of_community_moves_takes_few_jobs(spark):
    """Ten rings of six; on 8 cores with 4 shuffle partitions the moves took 537 jobs (now 367) while each round joined the links again for its modularity."""
    edges = spark.range(60).select(F.col("id").alias("source_id"), ((F.col("id") / 6).cast("long") * 6 + (F.col("id") + 1) % 6).alias("target_id"))
    spark.sparkContext.setJobGroup("moves", "moves")
    try:
        rows = graph.communities_by_modularity(spark.range(60), edges).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("moves")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {r["community"] for r in rows} == set(range(0, 60, 6))
    assert 0 < len(jobs) < 450



def test_the_innermost_function_needs_no_sorted_aggregation(spark):
    functions = spark.createDataFrame([("a", 1, 9, "x"), ("a", 2, 5, "y"), ("a", 2, 5, "z"), ("a", 2, 4, "b"), ("b", 1, 1, None)], "path string, start_line int, end_line int, name string")
    sites = spark.createDataFrame([("a", 3, 1), ("a", 3, 1), ("a", 5, 1), ("a", 9, 2), ("a", 10, 1), ("b", 1, 1), (None, 1, 1)], "path string, line int, col int")
    found = resolve.containing(sites, functions, innermost=True)
    want = {("a", 3, 1, "b"), ("a", 5, 1, "z"), ("a", 9, 2, "x"), ("a", 10, 1, None), ("b", 1, 1, "anonymous"), (None, 1, 1, None)}
    assert found.count() == 6 and {tuple(r) for r in found.collect()} == want
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()



def test_python_rows_of_other_kinds_are_not_made(monkeypatch):
    """Only rows that are asked for are made, in their places among all; nothing is unparsed for the others."""
    from tessera.operators.extract import python_source

    code = "import os\nfrom .a import (b, c as d)\nclass A(x.B):\n    def m(self, *, p: int = 3 + 4) -> 'A':\n        return [g(q) for q in f.h(1)(2)]\n@app.get('/r')\nasync def r(): return A()\n"
    whole = scan.extract_file("a.py", code, "python")
    assert [f["name"] for f in whole if f["what"] == "call"] == ["get", "A", "g", "h"]
    for what in ("symbol", "import", "inheritance", "call"):
        assert scan.extract_file("a.py", code, "python", (what,)) == [f for f in whole if f["what"] == what]
    unparsed = []
    monkeypatch.setattr(python_source.ast, "unparse", lambda e: unparsed.append(e) or "x")
    assert len(scan.extract_file("a.py", "def f(a: list[int] = 1 + 2) -> int: pass\nimport os\n", "python", ("import",))) == 1
    assert not unparsed



def test_pairs_of_related_chunks_are_not_shuffled(spark):
    """Three hundred chunks call one name that three hundred define: 90,000 pairs, far fewer rows in shuffles."""
    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).iterator()
        while found.hasNext():
            yield found.next()

    k = F.col("id")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    # ids come twice, with another file each time; the last chunk has no id
    rows = spark.range(602).select(F.when(k < 601, name(k % 300)).alias("id"), F.lit("f").alias("function_name"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("file_path"))
    rows = rows.withColumn("calls", F.array(F.lit("f"), F.lit("g"))).withColumn("dependencies", F.array(F.lit("p3"), F.lit(None))).withColumn("called_by", F.array(F.lit("p1:f"), F.lit("f")))
    last = max((s.stageId() for s in stages()), default=-1)
    found = resolve.related_chunks(rows).collect()
    written = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > last)
    ids = [f"c{i}" for i in range(300)] + [None]
    assert len(found) == 301 * 301 and {tuple(r) for r in found} == {(a, b) for a in ids for b in ids}
    assert written < 40000
