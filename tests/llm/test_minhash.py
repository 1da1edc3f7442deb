"""Groups of the tensored tables against all pairs; links by shared keys without all pairs of a key."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import links, minhash


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def all_pairs(rows):
    """(id, n, component) by comparing every pair."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r["id"], r["n"], r["component"]) for r in minhash.minhash_groups(docs, **options).collect()), key=repr)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    rows, shared = [], [f"s{i}" for i in range(200)]
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 300]))]
        rows += [(len(rows), " ".join(edited(rng, words, rng.randint(0, max(1, len(words) // 60))))) for _ in range(8)]
    # texts that share a long passage and are no copies of each other, and chains of edits
    rows += [(len(rows), " ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(80)])) for _ in range(25)]
    step = [f"c{i}" for i in range(150)]
    for _ in range(12):
        step = edited(rng, step, 1)
        rows.append((len(rows), " ".join(step)))
    rows += [(500, rows[0][1].upper()), (499, rows[0][1]), (600, "one two"), (601, "One  Two"), (602, ""), (603, "")]
    rng.shuffle(rows)
    assert run(spark, rows) == all_pairs(rows)


def test_recall_of_the_tables():
    """Of pairs just above the threshold, nearly all share a table: a key of either collection."""
    rng, found, tried = np.random.default_rng(5), 0, 400
    keys = minhash.Collections(minhash.SIDE, minhash.WIDTH)
    for _ in range(tried):
        common = rng.integers(0, 2**64, 350, dtype=np.uint64)
        a, b = (keys.keys(np.r_[common, rng.integers(0, 2**64, 30, dtype=np.uint64)])[0] for _ in range(2))
        same = a == b
        found += same[: keys.side].any() and same[keys.side :].any()
    assert found >= 0.99 * tried


def test_tables_need_both_collections(spark):
    """A text that agrees in keys of one collection only is in no table with the other."""
    t = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 7, 8]), (3, [1, 9, 3, 10])], "t long, keys array<long>")
    shared = minhash.table_entries(t, 2).groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("t")).where("size(t) > 1").collect()
    assert [r.t for r in shared] == [[1, 3]]


def test_spanned_equals_all_pairs_of_keys(spark):
    """Two crowded keys, most of whose rows are not linked; few comparisons for those that are."""
    rng = random.Random(2)
    group = {t: t % 7 if t < 140 else t for t in range(200)}
    members = spark.createDataFrame([(k, t, t % 5) for k in (1, 2) for t in range(200) if rng.random() < 0.8], "key long, t long, d long")
    asked = []

    def check(pairs):
        rows = [(r.a, r.b) for r in pairs.collect()]
        asked.extend(rows)
        return spark.createDataFrame([p for p in rows if group[p[0]] == group[p[1]]], "a long, b long")

    roots = {r.node: r.root for r in links.spanned(members, check).collect()}
    seen = {r.t for r in members.select("t").distinct().collect()}
    assert roots == {t: min(u for u in seen if group[u] == group[t]) for t in seen if t < 140}
    assert len(asked) == len(set(asked))


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted(((r["id"], r["n"], r["component"]) for r in minhash.minhash_groups(odd).collect()), key=repr)
    assert got == all_pairs(rows)
    assert minhash.minhash_groups(odd.where("false")).count() == 0
    assert [r.component for r in minhash.minhash_groups(odd.where("doc_id is null")).collect()] == [None]
