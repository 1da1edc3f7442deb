"""Block-max search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def every_score(docs, items, k):
    known = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, words = len(known), sum(m for _, _, m in known)
    df = Counter(w for _, c, _ in known for w in c)
    found = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for d, c, m in known:
            s = 0
            for w in terms(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    s += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * (75 + 25 * m * n // words)))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        found += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in lexical.search(d, i, **options).collect()), key=repr)


@pytest.mark.parametrize("block, query_chars", [(4, 1 << 20), (64, 300)])
def test_equals_scoring_everything(spark, block, query_chars):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)] + ["Été", "x9", "мир"]
    text = lambda n: " ".join(rng.choices(words, weights=range(1, 64), k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(30)]  # ties at the edge of the result
    items = [(i, text(rng.randint(1, 12))) for i in range(15)]
    assert run(spark, docs, items, k=7, block=block, band=3, query_chars=query_chars) == every_score(docs, items, 7)


def test_bounds_skip_blocks(spark, monkeypatch):
    """Blocks that cannot reach the k-th score are not scored; without bounds the result is the same."""
    docs = [(i, "common " * 20 + (f"rare{i}" if i < 6 else "")) for i in range(400)]
    items = [(0, "rare1 rare2 rare3 common")]
    queries = lexical.Queries.of([items[0][1].encode()])
    index = [lexical.bounds(lexical.np.array([0, 3]), lexical.np.array([900, 20]), queries, lexical.np.array([5, 5, 5, 1]))]
    assert index[0].tolist() == [5 * 900 + 20]
    fast = run(spark, docs, items, k=3, block=8)
    monkeypatch.setattr(lexical, "bounds", lambda term, most, q, w: lexical.np.full(len(q), 1 << 60))
    assert fast == run(spark, docs, items, k=3, block=8) == every_score(docs, items, 3)


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(0, "fox DOG lazy"), (0, "мир"), (1, None), (None, "w7 w8"), (2, "!!!"), (2, "!!!")], "item_id long, text string")
    got = sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in lexical.search(odd, items).collect()), key=repr)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == every_score(docs, [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert lexical.search(odd.where("false"), items).count() == 0 and lexical.search(odd, items.where("false")).count() == 0
