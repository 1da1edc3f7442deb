"""Groups of families against all pairs, in rows that grow with the family and not with its square."""

import random

import pytest

from tessera.llm import components, families


def all_pairs(sets, num, den):
    up = {t: t for t in sets}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    size = {}
    for t in sets:
        size[root(t)] = size.get(root(t), 0) + 1
    return {t: root(t) for t in sets if size[root(t)] > 1}


def run(spark, sets, num, den, of=None):
    of = spark.createDataFrame([(t, (of or {}).get(t, 0)) for t in sets], "t long, g long")
    rows = spark.createDataFrame([(t, sorted(s)) for t, s in sets.items()], "t long, h array<long>")
    return {r.node: r.root for r in families.linked(of, rows, num, den).collect()}


@pytest.mark.parametrize("seed, num, den", [(0, 85, 100), (1, 4, 5), (2, 1, 2)])
def test_families_equal_all_pairs(spark, seed, num, den):
    rng, sets = random.Random(seed), {}
    for f in range(5):  # families within one family, chains, rows alone, an empty set
        base = set(rng.sample(range(300), 40))
        for _ in range(25):
            base = base if rng.random() < 0.8 else (base - set(rng.sample(sorted(base), 3))) | set(rng.sample(range(300), 3))
            own = set(base) - set(rng.sample(sorted(base), rng.randrange(7)))
            sets[len(sets)] = own | {1000 + rng.randrange(10**6) for _ in range(rng.randrange(5))}
    sets[len(sets)] = set()
    sets[len(sets)] = {5}
    assert run(spark, sets, num, den) == all_pairs(sets, num, den)
    halves = {t: t % 2 for t in sets}
    want = {}
    for half in (0, 1):
        want |= all_pairs({t: s for t, s in sets.items() if t % 2 == half}, num, den)
    assert run(spark, sets, num, den, halves) == want


def test_a_family_of_unlinked_copies_costs_no_pairs(spark, monkeypatch):
    """Copies with so many edits each that no two are linked: 80,000 pairs, all of which were compared."""
    rng, made, cut = random.Random(3), [], families.cut

    def counted(df):
        df = cut(df)
        made.append(df.count())
        return df

    monkeypatch.setattr(families, "cut", counted)
    sets = {t: set(rng.sample(range(150), 135)) | {1000 + 20 * t + i for i in range(15)} for t in range(400)}
    assert run(spark, sets, 85, 100) == all_pairs(sets, 85, 100) == {}
    assert max(made) < 40 * len(sets)


def test_few_rows_are_few_tasks_however_many_partitions(spark, monkeypatch):
    """Rounds over a few hundred rows wrote as many files a shuffle as there are shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, made, cut = {k: spark.conf.get(k) for k in held}, [], components.cut

    def counted(df):
        df = cut(df)
        made.append(df.rdd.getNumPartitions())
        return df

    rng = random.Random(4)
    sets = {t: set(rng.sample(range(150), 135)) | {1000 + 20 * (t // 2) + i for i in range(15)} for t in range(100)}
    edges = spark.createDataFrame([(t, t + 1) for t in range(40)], "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(components, "cut", counted)
        assert {r.root for r in components.connected_components(edges).collect()} == {0}
        assert len(made) > 2 and max(made[1:]) == 1
        monkeypatch.setattr(families, "cut", counted)
        made.clear()
        assert run(spark, sets, 85, 100) == all_pairs(sets, 85, 100)
        assert sum(n > 4 for n in made) * 3 <= len(made)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def mixed(seed):
    """A family of six families, none of whose elements most of it has; half of the rows have no link."""
    rng, sets = random.Random(seed), {}
    for f in range(6):
        for i in range(10):
            gone = 4 if i % 2 else 15
            sets[len(sets)] = set(rng.sample(range(1000 * f, 1000 * f + 100), 100 - gone)) | {10**6 + 100 * len(sets) + j for j in range(gone)}
    return sets


def test_a_small_family_is_compared_in_a_task(spark, monkeypatch):
    """Each rare element made another copy of all differences that have it: several times the sets for a round."""
    made, cut = [], families.cut

    def counted(df):
        df = cut(df)
        made.append(df.selectExpr("coalesce(sum(size(d)), 0)").first()[0] if "d" in df.columns else 0)
        return df

    monkeypatch.setattr(families, "cut", counted)
    sets = mixed(6)
    assert run(spark, sets, 4, 5) == all_pairs(sets, 4, 5) != {}
    assert max(made) == sum(map(len, sets.values())) and sum(made) == max(made)


@pytest.mark.parametrize("within, elements", [(0, 1 << 20), (128, 500)])
def test_bounds_of_a_task_change_nothing(spark, monkeypatch, within, elements):
    monkeypatch.setattr(families, "WITHIN", within)
    monkeypatch.setattr(families, "ELEMENTS", elements)
    monkeypatch.setattr(families, "_ELEMENTS_AT_ONCE", 64)
    sets = mixed(7) | {100: set(), 101: set(), 102: {1}}
    assert run(spark, sets, 4, 5) == all_pairs(sets, 4, 5)
    thirds = {t: t % 3 for t in sets}
    want = {}
    for third in range(3):
        want |= all_pairs({t: s for t, s in sets.items() if t % 3 == third}, 4, 5)
    assert run(spark, sets, 4, 5, thirds) == want
