"""Filtered rounds against comparing every part with every entry."""

import random

import numpy as np
import pytest

from tessera.llm import codes


def plain(points, entries):
    """The nearest entry in Python's integers, the lower index of equal ones."""
    return [min(range(len(entries)), key=lambda e: (sum((int(x) - int(y)) ** 2 for x, y in zip(p, entries[e])), e)) for p in points]


def every_entry(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, codes, error, label_error, digest) of rows (id, vector, label) of one dimension."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[list(map(int, p)) for p in np.array_split(np.array(v, dtype=object), parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            chosen = plain([c[p] for c in cut], books[p])
            for e in set(chosen):
                own = [c[p] for c, x in zip(cut, chosen) if x == e]
                books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    coded = [plain([c[p] for c in cut], books[p]) for p in range(parts)]
    error = [sum(sum((x - y) ** 2 for x, y in zip(c[p], books[p][coded[p][k]])) for p in range(parts)) for k, c in enumerate(cut)]
    total = {}
    for (_, _, label), e in zip(kept, error):
        total[label] = total.get(label, 0) + e
    return sorted(((i, [coded[p][k] for p in range(parts)], error[k], total[label], codes.digest(books)) for k, (i, _, label) in enumerate(kept)), key=repr)


def run(df, **options):
    return sorted(((r["id"], r["codes"], r["error"], r["label_error"], r["digest"]) for r in codes.encode(df, **options).collect()), key=repr)


@pytest.mark.parametrize("kind", ["normal", "grid", "far"])
def test_assignment_with_ties(kind):
    """Whole subtrees and single points, ties between entries, and magnitudes beyond 64 bits."""
    rng = np.random.default_rng(3)
    points = {"normal": rng.normal(0, 500, (900, 4)), "grid": rng.integers(0, 4, (900, 3)), "far": rng.integers(-4, 4, (300, 2)) * 10.0**12}[kind].astype(np.int64)
    entries = points[rng.integers(0, len(points), 16)].copy()
    entries[5] = entries[2]
    if kind == "far":
        points, entries = points.astype(object), entries.astype(object)
    tree = codes.build(points, leaf=8)
    chosen, count, total = codes.assign(tree, entries)
    want = plain(points, entries)
    assert chosen.tolist() == want and 5 not in want
    assert count.tolist() == [want.count(e) for e in range(16)]
    assert [list(map(int, t)) for t in total] == [[int(sum(int(p[c]) for p, w in zip(points, want) if w == e)) for c in range(points.shape[1])] for e in range(16)]


def test_subtrees_go_at_once(monkeypatch):
    """Far groups are given away without looking at their points."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (500, 2)) + 10_000 * k for k in range(4)]).astype(np.int64)
    tree = codes.build(points, leaf=500)
    tree.points[:] = 0  # nothing may read them
    chosen, count, _ = codes.assign(tree, np.array([[25 + 10_000 * k] * 2 for k in range(4)], dtype=np.int64))
    assert count.tolist() == [500] * 4 and chosen.tolist() == [k for k in range(4) for _ in range(500)]


def test_equals_comparing_everything(spark):
    rng = random.Random(4)
    rows = [(i * 3, [rng.gauss(i % 5, 0.3) for _ in range(16)], i % 3 if i % 4 else None) for i in range(300)]
    rows += [(1, None, 0), (2, [1.0] * 15 + [None], 0), (4, [float("nan")] * 16, 0), (5, [float("inf")] * 16, 0), (7, rows[0][1], 0), (7, rows[0][1], 0), (None, rows[1][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert run(df, block=64, leaf=4) == every_entry(rows)
    assert run(df.limit(5)) == every_entry([tuple(r) for r in df.limit(5).collect()])


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label string, id string, dim int, v int"
    rows = [(1, [1.0, 2.0, 3.0], "a", "x", 1, 1), (2, [1e300, -1e300, 5.0], None, "y", 1, 1), (3, [1.0], "a", "x", 1, 1), (4, [], "a", "x", 1, 1), (5, [0.5] * 3, None, None, None, None)]
    got = {r["id"]: r for r in codes.encode(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[4]["codes"] == [0] * 8 and all(r["error"] == 0 for r in got.values())
    assert [got[i]["codes"][0] for i in (1, 5, 2)] == [0, 2, 1] and got[1]["label"] == "a"
    assert codes.encode(spark.createDataFrame([], schema)).count() == 0
