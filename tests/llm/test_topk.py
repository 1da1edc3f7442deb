"""Exact search against brute force, also with bounds that prune, ties and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


def brute(rows, k, every):
    """Sorted (query, rank, id, score) over (id, vector) rows; only the query's own row takes no part."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for j, (c, y) in enumerate(rows) if j != i and len(y) == len(x))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("head,block,partial", [(4, 8, 2), (64, 16, 3), (1, 1000, 8)])
def test_random(spark, head, block, partial):
    rng = np.random.default_rng(head)
    raw = rng.normal(size=(150, 8)) * rng.exponential(1, size=(150, 1))
    raw[20:50] = raw[20]  # a third are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(raw)], "vec_id long, embedding array<double>")
    want = brute([(i, [int(np.floor(64 * x)) for x in v]) for i, v in enumerate(raw)], 5, 10)
    for band in (2, 16):
        got = topk.topk(df, F.col("id") % 10 == 0, k=5, head=head, block=block, partial=partial, band=band)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_repeated_ids(spark):
    rng = np.random.default_rng(3)
    ids = [int(i) for i in rng.choice([0, 0, 5, 10, 11, 20], 90)]
    rows = [(i, [int(v) for v in rng.integers(-2, 3, 2)]) for i in ids]
    df = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for k in (3, 20, 200):
        got = topk.topk(df, F.col("id") % 10 == 0, k=k, head=8, block=16, partial=1, band=2)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, k, 10)


def test_blocks_are_skipped(monkeypatch):
    """Short vectors behind long ones are never scored once the bound is up."""
    scored = []
    right = topk.exact_scores
    monkeypatch.setattr(topk, "exact_scores", lambda q, x: scored.append(q.shape[0] * x.shape[0]) or right(q, x))
    long, short = np.full((64, 4), 1000), np.ones((5000, 4), dtype=np.int64)
    s = topk.Searcher(np.eye(4), 5, 2, np.array([-1]), np.array([0]), np.array([[1, 2, 3, 4]]), np.array([-np.inf]))
    for x in (long, short):
        s.meet(np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=np.int64), x)
    assert sum(scored) == 64 and len(s.found[0][0]) == 5


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (None, [1.0, 1.0]), (11, [3.0]), (40, [2.0]), (60, [0.0, 0.0]), (12, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as score")
    got = sorted(tuple(r) for r in topk.topk(df, F.col("id") % 20 == 0, k=4).collect())
    assert got == [(0, 1, 5, 20480), (0, 2, 5, 20480), (0, 3, 20, 20480), (0, 4, 60, 0), (20, 1, 0, 20480), (20, 2, 5, 20480), (20, 3, 5, 20480), (20, 4, 60, 0), (40, 1, 11, 24576), (60, 1, 0, 0), (60, 2, 5, 0), (60, 3, 5, 0), (60, 4, 20, 0)]
    assert topk.topk(df.where("false"), F.col("id") % 20 == 0).count() == 0


def test_large_numbers():
    q, x = np.array([[2**40, 1]]), np.array([[2**40, 5], [3, 4]])
    assert topk.exact_scores(q, x).tolist() == [[2**63 - 1, 3 * 2**40 + 4]]
    assert topk.exact_scores(np.array([[2**30, 1]]), np.array([[2**30, 5]])).tolist() == [[2**60 + 5]]
