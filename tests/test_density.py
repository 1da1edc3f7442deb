"""Clusters against a single-linkage tree built edge by edge, and neighbours against all distances."""

import numpy as np
import pytest

from tessera.operators import density, layout


def condensed(ids, v, least):
    """Labels by joining all pairs in order; each set keeps its size and, once it is of the least size, its leaf."""
    n = len(ids)
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
    i, j = np.triu_indices(n, 1)
    root, members, leaf, done = list(range(n)), {k: [k] for k in range(n)}, dict.fromkeys(range(n)), []

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in np.lexsort((j, i, d[i, j])):
        a, b = top(i[k]), top(j[k])
        if a == b:
            continue
        big = [len(members[a]) >= least, len(members[b]) >= least]
        if all(big):
            done += [list(members[s]) for s in (a, b) if leaf[s] is None]
            state = "split"
        else:
            state = leaf[a] if big[0] else leaf[b] if big[1] else None
        root[b] = a
        members[a] += members.pop(b)
        leaf[a] = state
    label = dict.fromkeys(ids, -1)
    for number, rows in enumerate(sorted(done, key=lambda rows: min(ids[r] for r in rows))):
        label.update({ids[r]: number for r in rows})
    return label


def table(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v)], "id long, v array<double>")


@pytest.mark.parametrize("seed, least", [(0, 2), (1, 6), (2, 15)])
def test_clusters_equal_single_linkage(spark, seed, least):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(c, s, (60, 3)) for c, s in ((0, 0.3), (2, 0.5), (9, 1.5))] + [rng.uniform(-5, 12, (20, 3))])
    v[5] = v[7]
    ids = np.arange(len(v)) * 3 + 1
    got = {r.id: r.cluster for r in density.density_clusters(table(spark, ids, v), min_cluster_size=least, block=32).collect()}
    assert got == condensed(ids.tolist(), v, least)


def test_chains_and_equal_rows(spark):
    """Distances that grow along a line, and a grid full of ties."""
    line = np.cumsum(np.arange(60))[:, None] * np.ones((1, 2))
    grid = np.array([(x, y) for x in range(8) for y in range(8)] + [(x + 30, y) for x in range(5) for y in range(5)], dtype=float)
    for v in (line, grid, np.zeros((12, 2))):
        ids = list(range(len(v)))
        got = {r.id: r.cluster for r in density.density_clusters(table(spark, ids, v), min_cluster_size=5, block=16).collect()}
        assert got == condensed(ids, v, 5)


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    v, ids = np.array([r.embedding for r in rows], dtype=np.float64), [r.vec_id for r in rows]
    found = density.density_clusters(table(spark, ids, v))
    got = {r.id: r.cluster for r in found.collect()}
    assert got == condensed(ids, v, max(2, len(ids) // 40))
    row = density.cluster_counts(found).first()
    assert (row.clusters, row.noise, row.members) == (len({c for c in got.values() if c >= 0}), sum(c < 0 for c in got.values()), sum(c >= 0 for c in got.values()))


def test_neighbours_equal_all_distances(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(0, 1, (150, 4)), 1)
    rows = density.numbered(table(spark, range(150), v), "id", "v")
    number = {r.n: r.id for r in rows.collect()}
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
    got = {}
    for r in density.neighbours(density.blocked(rows, 16, 7), 5).collect():
        got.setdefault(number[r.n], []).append((r["rank"], number[r.near], r.d2))
    for i in range(150):
        want = sorted((d[i, j], j) for j in range(150) if j != i)[:5]
        assert [(j, pytest.approx(x)) for x, j in want] == [(j, x) for _, j, x in sorted(got[i])]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (None, [1.0, 1.0]), (5, [None, 1.0]), (6, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {(r.id, r.cluster) for r in density.density_clusters(df).collect()} == {(1, -1), (6, -1)}
    assert density.density_clusters(df.where("false")).count() == 0


def test_layout_keeps_neighbours(spark):
    """More of the nearest rows stay near than under the projection that the layout begins with; a second run is the same."""
    rows = density.numbered(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), "vec_id", "embedding")
    blocks = density.blocked(rows)
    near = density.neighbours(blocks, 15).select("n", "near").cache()
    at = layout.laid_out(rows, blocks)
    kept, flat = layout.kept_neighbours(at, near, 15), layout.kept_neighbours(layout.projected(rows), near, 15)
    print(f"kept by the layout {kept:.3f}, by the projection {flat:.3f}")
    assert kept > 1.1 * flat
    assert sorted(at.collect()) == sorted(layout.laid_out(rows.repartition(3), blocks).collect())


def shuffled(spark, work):
    """Bytes that ``work`` writes to shuffles, and its result."""
    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).iterator()
        while found.hasNext():
            yield found.next()

    last = max((s.stageId() for s in stages()), default=-1)
    result = work()
    return sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last), result


def test_vectors_without_groups_move_a_few_times(spark):
    """Nothing can be left out by distance here; while each round moved every block of vectors to all cells, it took 15.68 MB (now 3.99)."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (900, 48))
    rows = density.numbered(table(spark, range(900), v), "id", "v")
    blocks = density.blocked(rows, 32)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables that are too large for it
    try:
        moved, edges = shuffled(spark, lambda: density.spanning_tree(blocks).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    print(f"{moved / 1e6:.2f} MB shuffled for {v.nbytes / 1e6:.2f} MB")
    assert len(edges) == 899 and moved < 15 * v.nbytes
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
    far, total, seen = d[0].copy(), 0.0, np.arange(900) == 0
    for _ in range(899):
        at = int(np.where(seen, np.inf, far).argmin())
        total, far, seen[at] = total + far[at], np.minimum(far, d[at]), True
    assert sum(e.d2 for e in edges) == pytest.approx(total)


@pytest.mark.parametrize("near", [1, 3])
def test_rows_whose_lists_are_too_short(spark, monkeypatch, near):
    """Families of equal and of near rows fill the lists; what leaves them is looked for among all vectors."""
    monkeypatch.setattr(density, "NEAR", near)
    monkeypatch.setattr(density, "GROUP_BYTES", 2048)
    rng = np.random.default_rng(near)
    v = np.round(np.repeat(rng.normal(0, 3, (12, 5)), 9, axis=0) + np.tile(rng.normal(0, 0.01, (9, 5)), (12, 1)), 2)
    v[:18] = np.repeat(v[:2], 9, axis=0)
    ids = list(range(len(v)))
    got = {r.id: r.cluster for r in density.density_clusters(table(spark, ids, v), min_cluster_size=4, block=16).collect()}
    assert got == condensed(ids, v, 4)


def test_the_layout_takes_the_lists_of_the_clusters(spark, monkeypatch):
    """The nearest rows are found once; the layout compared all vectors a second time."""
    from tessera.operators import cluster

    def again(*_):
        raise AssertionError("compared again")

    monkeypatch.setattr(layout, "neighbours", again)
    rng = np.random.default_rng(2)
    found = cluster.cluster_vectors(table(spark, range(60), rng.normal(0, 1, (60, 3))), "id", "v")
    assert len({r.id for r in found.collect()}) == 60
