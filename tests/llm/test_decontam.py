"""Leaks against a brute-force scan of all windows that share a shingle with an item."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, queries


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, items):
    found = {}
    bags = [(i, bag(words(t)), len(words(t))) for i, t in items if words(t)]
    for d, t in docs:
        w = words(t)
        mine = set(bag(w))
        for i, b, n in bags:
            if n >= 5 and not mine & set(b):
                continue  # every window has similarity 0
            for s in range(max(1, len(w) - n + 1)):
                c = bag(w[s : s + n]) if n >= 5 else Counter([tuple(w[s : s + n])]) if len(w) >= n else Counter()
                shared = sum((c & b).values())
                if shared:
                    sim = shared / (sum(c.values()) + sum(b.values()) - shared)
                    if sim >= 0.8:
                        found[d, i] = max(found.get((d, i), 0), sim)
    return found


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op5_decontamination(spark, sf).collect()}
    assert set(got) == set(want) and want
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_near_copies_short_items_and_odd_rows(spark):
    item = " ".join(f"word{i}" for i in range(60))
    edited = item.replace("word30 ", "other ")
    rows = [(1, f"lead in {item} and out"), (2, f"lead in {edited} and out"), (3, item.replace("word30 ", "x ").replace("word10 ", "y ").replace("word50 ", "z ")), (4, None), (5, ""), (6, "nothing of it"), (7, "say Hello, World! twice"), (1, f"lead in {item} and out"), (None, item), (8, " ".join(item.split()[5:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as size", "3 as h")
    items = spark.createDataFrame([(0, item), (9, item), (1, "hello world"), (2, None), (3, " ")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = sorted(((-1 if r.id is None else r.id), r.item_id) for r in decontam.report(docs, items).collect())
    want = brute(rows, [(0, item), (1, "hello world")])
    assert set(got) == {(-1 if d is None else d, i) for d, i in want} and got.count((1, 0)) == 2
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d in {r[0] for r in rows} if d is not None and (d, 0) not in want and (d, 1) not in want)
    assert decontam.report(docs.where("false"), items).count() == 0 and decontam.report(docs, items.where("false")).count() == 0


def edited(words, rng):
    """A text with a changed copy of an item in it: words replaced, left out, put in, stretches moved or repeated."""
    w = list(words)
    for _ in range(rng.choice((0, 1, 1, 2, 3))):
        i, k = rng.randrange(len(w)), rng.choice((1, 1, 2, 4))
        kind = rng.choice("rdimx")
        if kind == "r":
            w[i] = f"other{rng.randrange(99)}"
        elif kind == "d":
            del w[i : i + k]
        elif kind == "i":
            w[i:i] = [f"new{rng.randrange(99)}" for _ in range(k)]
        elif kind == "m":
            w = w[i:] + w[:i]
        else:
            w[i:i] = w[i : i + k]
        if len(w) < 8:
            return list(words)
    around = [[f"c{rng.randrange(500)}" for _ in range(rng.choice((0, 3, 150)))] for _ in range(2)]
    return around[0] + w + around[1]


def test_edits_and_reorderings_against_all_windows(spark):
    rng = random.Random(5)
    items = [(i, [f"i{i}w{j if rng.random() < 0.9 else j // 3}" for j in range(n)]) for i, n in enumerate([9, 12, 20, 35, 60, 90, 120, 120])]
    items.append((90, ("one two three four five six " * 8).split()))  # repeats its own shingles
    texts = [(d, " ".join(edited(rng.choice(items)[1], rng))) for d in range(1000)]
    swapped = items[6][1][60:] + items[6][1][:60]
    texts.append((5000, " ".join([f"a{i}" for i in range(150)] + swapped + [f"b{i}" for i in range(150)])))
    texts.append((5001, " ".join(items[3][1] + ["x"] * 5 + items[3][1])))  # twice in one text
    pairs = [(i, " ".join(w)) for i, w in items]
    want = brute(texts, pairs)
    got = {(r.id, r.item_id): r.similarity for r in decontam.report(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(pairs, "item_id long, text string")).collect()}
    assert len(want) > 500 and (5000, 6) in want
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_nothing_is_found_without_the_fingerprints(spark, monkeypatch):
    item = " ".join(f"word{i}" for i in range(60))
    docs, items = spark.createDataFrame([(1, item)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert decontam.report(docs, items).count() == 1
    right = decontam.simhash_of
    monkeypatch.setattr(decontam, "simhash_of", lambda rows, by: right(rows, by).withColumn("fp", F.col("fp") if "item" in by else F.expr("~fp")))
    assert decontam.report(docs, items).count() == 0


def test_simhash_of_is_the_majority(spark):
    random.seed(2)
    hashes = [random.getrandbits(64) - (1 << 63) for _ in range(7)]
    df = spark.createDataFrame([(1, h) for h in hashes] + [(2, -1), (3, 5), (3, 5), (3, -1)], "k long, h long")
    got = {r.k: r.fp % (1 << 64) for r in decontam.simhash_of(df, ["k"]).collect()}
    assert got[1] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 7)
    assert got[2] == (1 << 64) - 1 and got[3] == 5
