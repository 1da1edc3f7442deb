"""Fingerprints by the definition, groups against all pairs, both ways for crowded table entries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import connected_components


def plain(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d", "A b C d\te f a b c d", "é À ß ÀÉ mixed CASE words here", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def groups(fps):
    u = np.unique(np.array(fps, dtype=np.uint64))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    label = np.arange(len(u))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            return {int(f): int(u[k]) for f, k in zip(u, label)}
        label = new


@pytest.mark.parametrize("crowd,parts", [(3, None), (4096, None), (4096, 2)])
def test_groups_against_all_pairs(spark, crowd, parts):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base[:6]:  # chains and clusters of near fingerprints, one of them large
        for _ in range(40 if b == base[0] else 6):
            x = fps[-1] if rng.random() < 0.5 else b
            for j in rng.choice(64, rng.integers(0, 6), replace=False):
                x = x ^ np.uint64(1 << int(j))
            fps.append(x)
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in np.array(fps, dtype=np.uint64)], "fp long")
    links = simhash.fingerprint_links(df, bucket_rows=crowd, parts=parts)
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = groups(fps)
    by_root = {}
    for f, r in want.items():
        by_root.setdefault(r, set()).add(f)
    found = {}
    for f in want:
        signed = int(np.uint64(f).view(np.int64))
        found.setdefault(got.get(signed, signed), set()).add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, found.values()))


def test_segments_cover_the_radius():
    for radius, parts in ((4, 3), (16, 8), (3, 4)):
        segs = simhash.segments(radius, parts)
        assert sum(b + 1 for _, _, b in segs) > radius and sum(w for _, w, _ in segs) == 64


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = simhash.simhash_groups(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.id: r.fp % (1 << 64) for r in rows} == {i: plain(t) for i, t in texts.items()}
    root = groups([plain(t) for t in texts.values()])
    least = {}
    for i, t in sorted(texts.items()):
        least.setdefault(root[plain(t)], i)
    assert {r.id: r.component for r in rows} == {i: least[root[plain(t)]] for i, t in texts.items()}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, k) for k in range(201, 260)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and all(got[k] == 200 for k in range(200, 260)) and 7 in got
    assert connected_components(edges.limit(0)).count() == 0


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [1, 2, 5, 7]
    nameless = spark.createDataFrame([(None, "q w e r t"), (None, "q w e r t"), (5, "a b c d"), (5, "zz yy xx ww vv")], "doc_id long, text string")
    assert simhash.keep_one(nameless).count() == 3
    assert simhash.keep_one(odd.where("false")).count() == 0
    assert simhash.simhash_groups(odd).count() == odd.count()
    plain_ids = odd.where("doc_id in (2, 3, 5)")
    assert sorted(r.doc_id for r in simhash.keep_one(plain_ids).collect()) == [2, 5]


def shingle_set(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", w) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def similar_pairs(texts, least=0.8):
    """All pairs of ids with a similarity of ``least``, over an inverted index."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where = {}
    for i, s in sets.items():
        for x in s or {None}:
            where.setdefault(x, []).append(i)
    found = set()
    for i, s in sets.items():
        shared = Counter(j for x in s or {None} for j in where[x] if j > i)
        found |= {(i, j) for j, n in shared.items() if not s or n >= least * (len(s) + len(sets[j]) - n)}
    return found


def classes(ids, pairs):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_similar_groups_of_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: r.component for r in simhash.similar_groups(docs).collect()}
    assert got == classes(texts, similar_pairs(texts))


def test_scattered_edits(spark):
    """Copies with words replaced, put in and left out, down to the similarity asked for, of texts of any length."""
    rng, texts = random.Random(4), {}
    banner = " ".join(f"banner{i}" for i in range(30))  # in every text, and more than a piece
    for g in range(150):
        n = rng.choice((8, 15, 30, 60, 150, 400, 1500))
        base = [f"t{rng.randrange(3000)}" for _ in range(n)] + banner.split()
        texts[10 * g] = " ".join(base)
        for k in range(1, rng.choice((2, 4, 9))):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, n // 45 + 1))):
                i = rng.randrange(len(w))
                w[i : i + rng.choice((0, 1))] = [f"t{rng.randrange(3000)}"] * rng.choice((0, 1, 1))
            texts[10 * g + k] = " ".join(w)
    want = similar_pairs(texts)
    got = {r.id: r.component for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(want) > 300 and got == classes(texts, want)


def test_pairs_whose_passage_stands_in_denser_texts(spark):
    """Pairs of 0.9 over a passage that many longer and more connected texts have as well."""
    rng, texts = random.Random(6), {}
    for g in range(20):
        shared = [f"g{g}s{i}" for i in range(120)]
        for k in range(2):
            texts[100 * g + k] = " ".join(shared + [f"o{g}{k}{i}" for i in range(6)])
        crowd = [f"g{g}c{i}" for i in range(400)]
        for k in range(2, 8):
            own = list(crowd)
            own[rng.randrange(400)] = f"x{k}"
            texts[100 * g + k] = " ".join(shared + own)
    got = {r.id: r.component for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == classes(texts, similar_pairs(texts))
    assert all(got[100 * g + 1] == 100 * g and got[100 * g + 7] == 100 * g + 2 for g in range(20))


def test_columns_named_like_inner_ones(spark):
    rows = spark.createDataFrame([(1, "q w e r t y", "a", "b"), (1, "q w e r t y", "a", "b"), (2, "q w e r t y", "c", "d")], "doc_id long, text string, _fp string, _gone string").selectExpr("*", "'x' as _key", "'y' as _kept", "1 as k")
    for r in (rows, rows.where("doc_id = 2")):
        kept = simhash.keep_one(r)
        assert kept.columns == rows.columns and kept.count() == 1
