"""Repeated passages against all windows of 50 words."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import suffixes


def brute(docs, least):
    places = defaultdict(list)
    for i, t in sorted(docs.items()):
        w = (t or "").split()
        for s in range(len(w) - least + 1):
            places[tuple(w[s : s + least])].append((i, s))
    every, later = defaultdict(set), defaultdict(set)
    for v in places.values():
        if len(v) > 1:
            for k, (i, s) in enumerate(v):
                every[i].update(range(s, s + least))
                if k:
                    later[i].update(range(s, s + least))
    return every, later


def cover(spans):
    return {k for s in spans for k in range(s["start"], s["end"])}


def check(df, docs, least, gram):
    every, later = brute(docs, least)
    for r in suffixes.repeats(df, least=least, gram=gram).collect():
        assert cover(r.repeated) == every[r.id], r.id
        assert cover(r.later) == later[r.id], r.id


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}, suffixes.MIN_WORDS, suffixes.GRAM)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edited_copies(spark, seed):
    """Many copies of one text with random edits: matches that neighbours in the sorted order hide."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    docs = {}
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(5)}"
        docs[i] = " ".join(w[rng.randint(0, 20) :])
    docs[40] = " ".join(["again"] * 70)
    docs[41] = docs[0]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(df, docs, 12, 4)


def test_kept_positions_depend_on_the_passage_only():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 32, 50, dtype=np.uint32)
    chosen = set()
    for _ in range(20):
        text = np.r_[rng.integers(0, 1 << 32, 70, dtype=np.uint32), shared, rng.integers(0, 1 << 32, 70, dtype=np.uint32)]
        p, _, first, last = suffixes.kept_positions(text)
        chosen.add(next(int(a) - 70 for a, f, la in zip(p, first, last) if f <= 70 <= la))
    assert len(chosen) == 1


def test_odd_rows(spark, odd):
    got = suffixes.repeats(odd).collect()
    assert len(got) == odd.count()
    by = {r.id: r for r in got if r.id in (2, 3, 5, 6)}
    assert by[2].words == 0 and by[3].repeated == []
    assert cover(by[5].repeated) == set(range(60_000)) and cover(by[6].repeated) >= set(range(59_999))
    assert suffixes.repeats(odd.where("false")).count() == 0
    short = odd.where("doc_id in (1, 3)")
    assert all(r.repeated == [] for r in suffixes.repeats(short).collect())
