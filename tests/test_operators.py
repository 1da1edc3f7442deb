"""Operators on hand-made rows: boundaries, invariants and what SQL cannot express."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunks, cluster, files, graph, pr, resolve, retrieve, store, sync, tree, validate, vector
from tessera.sources import embeddings, repos
from tessera.streaming import sync_jobs


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_scalars(spark):
    lit = F.lit
    for name in ("src/a.py:f", "é", ""):
        assert one(spark, text.uuid5(lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    for s in ("a-b v2api", "FOO_bar baz", "x"):
        assert one(spark, text.title_case(lit(s))) == s.title()
    assert one(spark, text.sanitize_name(lit(" My.Repo/é--1 "))) == "my_repo_é_1"
    once = one(spark, text.sanitize_name(lit("A..b")))
    assert one(spark, text.sanitize_name(lit(once))) == once
    assert one(spark, text.collection_name(lit(None).cast("string"), lit("Org-1"), lit("repo.x"), lit("feat/x"))) == "org_1_org_1_repo_x_feat/x"
    assert one(spark, text.collection_name(lit("o"), lit(""), lit("r"), lit("b"))) is None
    assert one(spark, text.repo_slug(lit("a_b_c_d_main"))) == "c_d" and one(spark, text.repo_slug(lit("a_b_C"))) == "c"
    assert one(spark, text.lines_between(lit("a\r\nb\nc"), lit(0), lit(2))) == "a\nb"
    assert one(spark, text.chat_title(lit("x" * 40))) == "x" * 36 + "…"
    assert one(spark, text.identifier_words(lit("getHTTPServer2 fooBar"))) == ["get", "http", "server", "foo", "bar"]
    assert one(spark, text.cleaned_comment(lit("## **Hi** `x`  🎉"))) == "Hi x"


def test_code_filter(spark):
    rows = [("src/a.py", "x"), ("node_modules/q.js", "x"), (".hidden/r.py", "x"), ("README.md", "x"), ("a/b.py", "x" * 199_999), ("a/c.py", "x" * 200_000), ("a/Makefile", "x"), (".dot.py", "x")]
    df = spark.createDataFrame(rows, "path string, content string")
    assert {r.path for r in df.where(files.is_code(df.path, df.content)).collect()} == {"src/a.py", "a/b.py", ".dot.py"}


@pytest.mark.parametrize("n,points", [(5, 0), (6, 8), (10, 8), (11, 15), (20, 15), (21, 25)])
def test_file_points(spark, n, points):
    assert one(spark, pr.above(F.lit(n), pr.FILE_POINTS)) == points


def test_pr_risk(spark):
    f = spark.createDataFrame([(1, "auth/a.py", 3000, 600)] * 21 + [(2, "docs/a.md", 1, 0), (3, "core/config.py", 1, 0)], "pr_number long, file_path string, additions int, deletions int")
    i = spark.createDataFrame([(1, "auth/a.py", "critical", "bug", "d", "e"), (2, "schema/x.py", "critical", "bug", "d", "validation"), (2, "schema/x.py", "medium", "bug", "d", "e"), (2, "schema/x.py", "critical", "bug", "d", "will break")], "pr_number long, file string, severity string, type string, description string, explanation string")
    got = {r.pr_number: r for r in pr.risk(f, i).collect()}
    assert (got[1].score, got[1].level) == (100, "critical")
    assert (got[2].score, got[2].level) == (33, "high") and "1 critical breaking issue(s) detected" in got[2].factors
    assert (got[3].score, got[3].level, got[3].explanation) == (0, "low", "This PR appears to be low risk. Changes appear safe to merge.")


def test_graph_risk_two_communities(spark):
    nodes = spark.createDataFrame([("a", 1, 11), ("b", 1, 1), ("c", 5, 2), ("d", None, None)], "id string, start_line int, end_line int")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "zz")], "source_id string, target_id string")
    comm = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "id string, community long")
    got = {r.id: r for r in graph.risk_scores(nodes, edges, comm).collect()}
    assert (got["b"].in_degree, got["b"].crossings, got["c"].crossings, got["a"].out_degree) == (2, 1, 1, 2)
    assert got["a"].loc == 10 and got["c"].loc == 0 and got["d"].risk_score == 0
    assert all(0 <= r.risk_score <= 1 for r in got.values())
    assert [one(spark, graph.risk_level(F.lit(s))) for s in (0.2499, 0.25, 0.5, 0.75)] == ["low", "medium", "high", "critical"]


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    edges = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0")], "source_id string, target_id string")
    nodes = spark.createDataFrame([(f"{p}{i}",) for p in "ab" for i in range(5)] + [("lone",)], "id string")
    found = graph.communities_by_labels(nodes, edges).cache()
    assert found.count() == 11 and found.select("id").distinct().count() == 11
    assert graph.modularity(edges, found) > graph.modularity(edges, nodes.select("id", F.col("id").alias("community")))


def test_clusters(spark):
    """Two groups far apart and a row between them; near rows stay near in the plane."""
    v = spark.createDataFrame([(i, [10.0 * (i % 2), 0.1 * (i // 2), 0.01 * (i % 3)]) for i in range(20)] + [(20, [5.0, 50.0, 0.0])], "id long, v array<double>")
    got = {r.id: r for r in cluster.cluster_vectors(v, "id", "v", 5).collect()}
    assert {i: r.cluster for i, r in got.items()} == {i: i % 2 if i < 20 else -1 for i in range(21)}
    assert all(-1 <= r.x <= 1 and -1 <= r.y <= 1 for r in got.values())
    assert {r.cluster for r in cluster.cluster_vectors(v.limit(2), "id", "v", 2).collect()} == {-1}
    labels = cluster.cluster_labels(spark.createDataFrame([(0, "getUser"), (0, "userName"), (1, "get"), (2, "x")], "cluster int, name string"))
    assert {r.cluster: r.label for r in labels.collect()} == {0: "User & Name", 1: "General", 2: "General"}


def test_upsert_keeps_old_and_is_idempotent(spark):
    schema = "k long, note string, tags array<string>, v long, created long"
    old = spark.createDataFrame([(1, "n", ["t"], 1, 10), (2, "m", None, 2, 20)], schema)
    new = spark.createDataFrame([(1, "", [], 5, 99), (3, "z", None, 3, 30)], schema)
    merge = lambda o, n: store.upsert(o, n, ["k"], ["note", "tags"], ["v"], "created")
    got = {r.k: r for r in merge(old, new).collect()}
    assert (got[1].note, got[1].tags, got[1].v, got[1].created, got[1].action) == ("n", ["t"], 5, 10, "updated")
    assert got[2].action == "kept" and got[3].action == "created"
    once = merge(old, new).drop("action")
    assert sorted(map(tuple, merge(once, new).drop("action").collect())) == sorted(map(tuple, once.collect()))


def test_snapshot_and_invalidation(spark):
    heads = lambda m: sync.heads(spark.createDataFrame([("r", m)], "repo_id string, heads map<string,string>"), "heads", "repo_id")
    old, new = heads({"main": "1", "dev": "2", "gone": "3"}), heads({"main": "1", "dev": "9", "new": "4"})
    assert {(r.branch, r.old_sha) for r in sync.changed_heads(old, new, "repo_id").collect()} == {("dev", "2"), ("new", None)}
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, []), (4, ["c", None])], "id long, file_paths array<string>")
    assert [r.id for r in sync.stale(docs, spark.createDataFrame([("b",)], "path string")).collect()] == [1]


def test_sync_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "heads")
    schema = "repo_id string, branch string, sha string, ordinal long"
    seen = []
    state = store.VersionedTable(spark, str(tmp_path / "state"))

    def run():
        sync_jobs.sync_stream(sync_jobs.head_updates(spark, src, schema), state, lambda df, i: seen.append(sorted(map(tuple, df.collect()))), str(tmp_path / "cp")).awaitTermination()

    spark.createDataFrame([("r", "main", "1", 1), ("r", "main", "2", 2), ("s", "dev", "1", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("r", "main", "2", 3), ("s", "dev", "7", 4)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert seen == [[("r", "main", "2", None), ("s", "dev", "1", None)], [("s", "dev", "7", "1")]]
    assert sorted(map(tuple, state.read().select("repo_id", "branch", "sha").collect())) == [("r", "main", "2"), ("s", "dev", "7")]


def test_unique_slugs(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "slug string")
    taken = spark.createDataFrame([("a",), ("a-2",), ("a-4",), ("b",), ("b-3",), ("c-2",), ("d",), ("d-02",)], "slug string")
    assert {r.slug: r.unique for r in store.unique_slugs(wanted, taken).collect()} == {"a": "a-3", "b": "b-2", "c": "c", "d": "d-2"}


def test_unique_slugs_of_several_askers(spark):
    wanted = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 0), ("b", 1)], "slug string, k int")
    taken = spark.createDataFrame([("a",), ("a-2",), ("a-4",), ("b-2",)], "slug string")
    got = {(r.slug, r.k): r.unique for r in store.unique_slugs(wanted, taken, order="k").collect()}
    assert got == {("a", 0): "a-3", ("a", 1): "a-5", ("a", 2): "a-6", ("a", 3): "a-7", ("a", 4): "a-8", ("b", 0): "b", ("b", 1): "b-3"}


def test_versions_are_not_lost(spark, tmp_path):
    one, two = (store.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    assert one.read() is None and one.version() == 0
    assert one.write(spark.range(1)) == 1
    base = one.version()
    assert two.write(spark.range(2), after=base) == 2
    with pytest.raises(store.StaleWrite):
        one.write(spark.range(3), after=base)
    assert one.write(spark.range(4)) == 3 and two.read().count() == 4
    (tmp_path / "t/_pointers/000000000004").touch()  # a writer that died
    two.PATIENCE = 0.1
    assert two.read().count() == 4 and two.write(spark.range(5)) == 5 and two.read().count() == 5


def test_closure_both_ways(spark):
    import random

    rng = random.Random(2)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)} | {(k, k + 1) for k in range(50, 90)}
    df = spark.createDataFrame(sorted(edges) + [(None, 1), (1, None)], "source_id long, target_id long")
    want = {}
    for s in {a for a, _ in edges}:
        level, seen, d = {s}, {s: 0}, 0
        while level:
            d += 1
            level = {b for a, b in edges if a in level} - set(seen)
            seen |= dict.fromkeys(level, d)
        want |= {(s, n): k for n, k in seen.items()}
    assert {(r.start, r.node): r.depth for r in graph.closure(df).collect()} == want
    starts = spark.createDataFrame([(50,), (3,), (999,)], "start long")
    some = {(r.start, r.node): r.depth for r in graph.closure(df, starts=starts).collect()}
    assert some == {k: d for k, d in want.items() if k[0] in (50, 3)} | {(s, s): 0 for s in (3, 50, 999)}
    assert {(r.start, r.node): r.depth for r in graph.closure(df, 4).collect()} == {k: d for k, d in want.items() if d <= 4}


def test_communities_by_modularity(spark):
    import random

    cliques = [(f"{g}{a}", f"{g}{b}") for g in "xyz" for a in range(5) for b in range(a)] + [("x0", "y0"), ("y1", "z1"), ("x0", "x0"), ("y0", "x0")]
    nodes = spark.createDataFrame([(f"{g}{a}",) for g in "xyz" for a in range(5)] + [("alone",)], "id string")
    got = {r.id: r.community for r in graph.communities_by_modularity(nodes, spark.createDataFrame(cliques, "source_id string, target_id string")).collect()}
    assert got == {f"{g}{a}": f"{g}0" for g in "xyz" for a in range(5)} | {"alone": "alone"}
    rng = random.Random(1)
    planted = [(a, b) for a in range(90) for b in range(a) if rng.random() < (0.35 if a % 3 == b % 3 else 0.03)]
    edges, nodes = spark.createDataFrame(planted, "source_id long, target_id long"), spark.range(90)
    found = graph.communities_by_modularity(nodes, edges)
    truth = nodes.selectExpr("id", "id % 3 as community")
    assert graph.modularity(edges, found) >= graph.modularity(edges, truth) - 0.02
    assert graph.modularity(edges, found) >= graph.modularity(edges, graph.communities_by_labels(nodes, edges)) - 1e-9


def test_occurrences(spark):
    from tessera.operators import contain

    texts = spark.createDataFrame([(1, "abcabc é🎉"), (2, "bc"), (3, None), (4, "")], "id long, content string")
    names = spark.createDataFrame([("abc",), ("bc",), ("🎉",), ("",), (None,), ("zz",), ("abc",)], "name string")
    want = {(1, "abc"), (1, "bc"), (1, "🎉"), (2, "bc")}
    for size in (1 << 20, 2):
        assert {tuple(r) for r in contain.occurrences(texts, names, block_chars=size).collect()} == want
    assert contain.occurrences(texts, names.where("false")).count() == 0


def test_vector_store(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 0.0])], "id long, v array<float>")
    scored = vector.similar_to(v, v.where("id = 1").select(F.col("v").alias("q")), "v")
    assert [r.id for r in vector.top_k(scored, 2, "id").collect()] == [1, 4] and scored.count() == 3
    assert retrieve.compass_k(3, 15) == 5 and retrieve.compass_k(0, 15) == 15 and retrieve.compass_k(9, 15) == 4
    assert [retrieve.clamp_top(n) for n in (None, 0, 5, 99)] == [10, 10, 5, 30]
    e = v.select(embeddings.embed_column(F.lit("a b a"), embeddings.hashing_embedder).alias("e")).first()["e"]
    assert abs(sum(x * x for x in e) - 1) < 1e-6


def test_graph_store_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c")], "repo_id string, id string")
    edges = spark.createDataFrame([("r1", "CALLS", "a", "b"), ("r1", "ODD", "a", "b"), ("r1", "CALLS", "a", "zz"), ("r2", "CALLS", "c", "c")], "repo_id string, type string, source_id string, target_id string")
    base = str(tmp_path / "g")
    repos.write_graph(nodes, edges, base)
    repos.write_graph(nodes.where("repo_id = 'r1'").limit(1), edges.limit(0), base)
    assert repos.read_graph(spark, base, "r2")[1].count() == 1
    assert repos.read_graph(spark, base, "none") is None
    repos.delete_graph(spark, base, "r2")
    assert repos.read_graph(spark, base, "r2") is None
    assert repos.read_graph(spark, base, "r1")[1].count() == 0 and repos.graph_exists(spark, base, "r1") and not repos.graph_exists(spark, base, "r2")


def test_sources(spark, tmp_path):
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/src/a.py").write_text("x = 1\n")
    got = repos.repository_files(spark, str(tmp_path / "repo"), "r", "main").collect()
    assert [(r.path, r.content) for r in got] == [("src/a.py", "x = 1\n")]
    for k in range(5):
        (tmp_path / f"repo/src/b{k}.py").write_text("y")
    assert [r.path for r in repos.repository_files(spark, str(tmp_path / "repo"), "r", "main").orderBy("ordinal").collect()] == ["src/a.py"] + [f"src/b{k}.py" for k in range(5)]
    people = spark.createDataFrame([("a", "User", 5, None), ("b", "Bot", 9, "B"), ("c", "User", 7, "C")], "login string, type string, contributions long, name string")
    assert [(r.name, r.contributions) for r in repos.contributors(people, "x").collect()] == [("C", "7"), ("a", "5")]
    vectors = spark.createDataFrame([("a", 1), ("b", 2)], "collection string, id long")
    assert repos.copy_collection(vectors, "a", "z").first()["collection"] == "z"
    with pytest.raises(ValueError):
        repos.copy_collection(vectors, "a", "b")
    repos.write_report({"chunks": vectors}, str(tmp_path / "out"), "20240101_000000", "collection")
    assert spark.read.json(str(tmp_path / "out/chunks")).count() == 2


def test_violations(spark):
    good = '{"sections":[{"title":"a"}],"code_references":["x"]}'
    bad = '{"sections":[' + ",".join(['{"title":"a"}'] * 11) + '],"code_references":[]}'
    df = spark.createDataFrame([(1, good), (2, bad), (3, "{"), (4, None)], "id long, body string")
    assert {(r.id, r.rule) for r in validate.violations(df, "documentation").collect()} == {(2, "sections"), (3, "json"), (4, "json")}
    seq = spark.createDataFrame([(1, '{"lifelines":[{"id":"a"}],"messages":[{"source":"a","target":"b"}],"fragments":[{"startIndex":0}]}')], "id long, body string")
    assert {r.rule for r in validate.violations(seq, "sequence").collect()} == {"lifelines", "ends", "fragments"}


def test_tree(spark):
    p = graph.path_prefixes(spark.createDataFrame([("src/a/b.py",), ("src/a/c.py",), ("/top.py",), ("src//d.py",)], "path string"))
    t = tree.nodes(p)
    assert {r.path for r in t.collect()} == {"src", "src/a", "src/a/b.py", "src/a/c.py", "top.py", "src/d.py"}
    assert {r.path: r.min_depth for r in tree.min_file_depth(p).collect()} == {"src": 1, "src/a": 1}
    assert {r.path: (r.files, r.folders) for r in tree.child_counts(t).collect()} == {"src": (1, 1), "src/a": (2, 0)}
    groups = tree.root_groups(t).select("group").distinct().orderBy(*tree.group_order()).collect()
    assert [r.group for r in groups] == ["src", "(root files)"]
    assert graph.hierarchy_edges(p).count() == 5  # src-a twice, two files in a, d


def test_strategies(spark):
    with pytest.raises(ValueError):
        chunks.create_chunks("other", None, None, None, None)


def test_unmatched_references(spark):
    """Case counts, underscores do not; the context is the lines around the first line that has the name."""
    lines = [f"line {i}" for i in range(20)]
    lines[8], lines[12] = "uses load_it_all here", "loaditall"
    chunks_ = spark.createDataFrame([(1, 1, "LoadItAll\nonly in other case"), (2, 2, "\n".join(lines)), (3, 3, "load_itall")], "id long, chunk_rank long, content string")
    refs = spark.createDataFrame([("loadItAll", None), ("loaditall", None), ("load_it_all", None), ("LoadItAll", None), ("two\nlines", None), ("_", None), ("done", 5)], "ref string, chunk_id long")
    got = {r.ref: (r.chunk_id, r.context) for r in resolve.unmatched_references(refs, chunks_).collect()}
    around = "\n".join(lines[3:14])
    assert got == {"loadItAll": (None, None), "loaditall": (2, around), "load_it_all": (2, around), "LoadItAll": (1, "LoadItAll\nonly in other case"), "two\nlines": (None, None), "_": (2, around)}


def test_diff_snippets(spark):
    """The line in its hunk; a line behind the hunk or without one falls back; nothing where there is no patch."""
    patch = "diff --git a b\n--- a/f\n+++ b/f\n@@ -1,3 +10,4 @@\n ten\n-gone\n+eleven\n\n twelve\n@@ -90 +100 @@\n+hundred\n" + "\n".join(f"+l{i}" for i in range(40))
    patches = spark.createDataFrame([("p", patch), ("q", "no hunk"), ("n", None)], "k string, patch string")
    wanted = spark.createDataFrame([("p", 11), ("p", 12), ("p", 100), ("p", 130), ("p", 5), ("q", 1), ("n", 1), ("none", 1)], "k string, target int")
    got = {(r.k, r.target): r.snippet for r in pr.diff_snippet(patches, wanted, "k").collect()}
    assert got["p", 11] == " ten\n-gone\n+eleven\n twelve\n+hundred\n+l0" and got["p", 12].endswith(" twelve\n+hundred\n+l0\n+l1\n+l2")
    assert got["p", 100].split("\n")[-6:] == ["+hundred", "+l0", "+l1", "+l2", "+l3", "+l4"]
    fallback = "@@ -1,3 +10,4 @@\n ten\n-gone\n+eleven\n twelve\n@@ -90 +100 @@\n+hundred\n" + "\n".join(f"+l{i}" for i in range(7))
    assert got["p", 5] == got["p", 130] == fallback
    assert got["q", 1] == got["n", 1] == got["none", 1] == ""


def test_containing_by_a_sweep(spark):
    """Nested, touching, equal and one-line functions, against looking at every function for every line."""
    rng = random.Random(8)
    functions = [(p, s, s + rng.choice((0, 1, 3, 9, 25)), rng.choice((None, f"f{k}"))) for k, (p, s) in enumerate((rng.choice("ab"), rng.randrange(80)) for _ in range(60))]
    functions += [("a", 100, 110, "one"), ("a", 110, 120, "two"), ("a", 100, 110, "same")]
    sites = [(p, line, f"c{line}") for p in "abc" for line in range(-1, 125)]
    got = resolve.containing(spark.createDataFrame(sites, "path string, line int, function_name string"), spark.createDataFrame(functions, "path string, start_line int, end_line int, name string")).collect()
    want = {}
    for p, line, _ in sites:
        inside = [(s, -e, n or "anonymous") for q, s, e, n in functions if q == p and s <= line <= e]
        want[p, line] = min(inside)[2] if inside else None
    assert len(got) == len(sites) and {(r.path, r.line): r.context for r in got} == want
