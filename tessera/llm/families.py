"""Links among sets that meet under keys, by their differences from what most of a family has. No pairs are made.

Sets that meet are first joined into families, whatever their similarity. With C the elements that over half of a family
has, a set A is told by its difference D from C: the elements in one of the two only. Two sets differ in
|D_A| + |D_B| - 2 |D_A ∩ D_B| elements, so with w = (q + p) |D| - (q - p) |A| their similarity is at least p / q just if
w_A + w_B <= 2 (q + p) |D_A ∩ D_B|.

Where w_A + w_B <= 0, both are linked with the set of the least w. A pair beyond that, of two groups so far, must have several elements
of its differences in common, one of them among the rarest of either. All sets with such an element are a family of the next round, in which
their differences stand for them. An element of a difference is in at most half of the differences of its family, so
families halve each round, and the groups are exactly those that all pairs of each first family would give.

A family of at most ``WITHIN`` rows and ``ELEMENTS`` elements needs no rounds: it goes to one task as it is, where its sets are
compared with each other. Only elements of larger families become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, cut, gathered, light, swept
from tessera.llm.components import connected_components
from tessera.llm.links import _same_rows

#: Rows of a family that meet what belongs to the family in one place.
TOGETHER = 64

#: Sets, or differences of sets, that are worth a task.
TASK_SETS = 2_000

#: Rows and elements of a family up to which a task compares it: some MB, and no more comparisons for a row than the first.
WITHIN, ELEMENTS = 128, 1 << 20

#: Elements that are counted at once in such a comparison.
_ELEMENTS_AT_ONCE = 4096


def meeting(members: DataFrame) -> DataFrame:
    """(t, g) of the rows of ``members`` (key, t) that meet others: ``g`` is the least row reachable over shared keys."""
    low = members.groupBy("key").agg(F.min("t").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "b")
    stars = members.join(light(low), "key").where("t != b").select(F.col("t").alias("a"), "b").distinct()
    return connected_components(stars).select(F.col("node").alias("t"), F.col("root").alias("g"))


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``m``, the number of rows of their family ``g``; a large family stays spread over the tasks."""
    sizes = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("m")))
    large = rows.join(light(sizes.where(F.col("m") > TOGETHER)), "g", "left")
    small = large.where("m is null").drop("m").join(sizes.where(F.col("m") <= TOGETHER), "g")
    return large.where("m is not null").select(*rows.columns, "m").unionByName(small.select(*rows.columns, "m"))


def _with(rows: DataFrame, families: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` (g, t, m, ..) with what ``families`` (g, m, ..) has of their family, ``TOGETHER`` of them in a place."""
    places = F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / TOGETHER))
    place = F.pmod(F.xxhash64("t"), F.floor((F.col("m") - 1) / TOGETHER) + 1)
    return rows.withColumn("_place", place).join(families.withColumn("_place", F.explode(places)).drop("m"), ["g", "_place"], how).drop("_place")


def _either(a: Column, b: Column) -> Column:
    """The elements that are in one of two sets only."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _joined(roots: DataFrame, new: DataFrame, rows: int) -> DataFrame:
    """``roots`` (node, root) of at most ``rows`` nodes with the links ``new`` (a, b), few of which join what isn't joined yet.
    Only the groups that these join are sought anew, not all their rows."""
    one = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
    ends = new.join(one("a"), "a", "left").join(one("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    more = cut(gathered(ends.where("a != b").distinct(), rows))
    if more.isEmpty():
        return roots
    moved = light(connected_components(more))
    kept = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return cut(gathered(kept.unionByName(moved.join(roots.select("node"), "node", "left_anti")), rows))


def _in_common(d: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    sizes = [len(x) for x in d]
    _, which, times = np.unique(np.concatenate(d), return_inverse=True, return_counts=True)
    shared = times > 1
    again = shared[which]
    row, column = np.repeat(np.arange(len(d)), sizes)[again], (np.cumsum(shared) - 1)[which[again]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(d), len(d)), dtype=np.int64)
    total = int(shared.sum())
    for low in range(0, total, _ELEMENTS_AT_ONCE):
        i, j = np.searchsorted(column, (low, low + _ELEMENTS_AT_ONCE))
        has = np.zeros((len(d), min(_ELEMENTS_AT_ONCE, total - low)), dtype=np.float32)
        has[row[i:j], column[i:j] - low] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def _stars(t: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, least row of its group) for the groups that ``near`` joins, but for the least rows themselves."""
    left = np.ones(len(t), dtype=bool)
    for start in np.argsort(t):
        if left[start]:
            left[start], queue = False, [start]
            while queue:
                found = np.flatnonzero(near[queue.pop()] & left)
                left[found] = False
                queue.extend(found)
                yield from ((int(t[x]), int(t[start])) for x in found)


def _within(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that join what all pairs within each family of ``rows`` (g, t, n, d) do; every family is in one task."""
    more, less = den + num, den - num

    def compared(t: list, n: list, d: list) -> Iterator[tuple[int, int]]:
        w = np.array([more * len(x) - less * y for x, y in zip(d, n)], dtype=np.int64)
        yield from _stars(np.array(t, dtype=np.int64), w[:, None] + w[None, :] <= 2 * more * _in_common(d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

        now, t, n, d, found = None, [], [], [], []
        for batch in batches:
            kinds, ids, sizes = (batch.column(c).to_pylist() for c in ("g", "t", "n"))
            lists = batch.column("d")
            for i, g in enumerate(kinds):
                if g != now:
                    found.extend(compared(t, n, d) if len(t) > 1 else ())
                    now, t, n, d = g, [], [], []
                t.append(ids[i])
                n.append(sizes[i])
                d.append(lists[i].values.to_numpy())
            if found:
                yield given(found)
                found = []
        if len(t) > 1:
            yield given(list(compared(t, n, d)))

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


def _small(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The families of ``rows`` (g, m, d, ..) that a task compares, and the others; ``n`` is the number of rows."""
    long = rows.where(F.col("m") <= WITHIN).groupBy("g").agg(F.sum(F.size("d")).alias("_e")).where(F.col("_e") > ELEMENTS)
    long = light(gathered(long.select("g"), n))
    few = F.col("m") <= WITHIN
    return rows.where(few).join(long, "g", "left_anti"), rows.where(~few).unionByName(rows.where(few).join(long, "g", "left_semi"))


def linked(of: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of all rows linked to another: those in one family of ``of``, as ``meeting`` gives it, whose sets have at least
    ``num`` / ``den`` of their union in common. ``sets`` has (t, h), ``h`` without repeats."""
    more, less = den + num, den - num
    every = n = of.count()
    rows = cut(gathered(_counted(of).join(sets, "t").select("g", "t", "m", F.size("h").alias("n"), F.col("h").alias("d")), n, TASK_SETS))
    roots = None
    while True:
        few = lambda df, n=n: gathered(df, n)
        swept(rows.sparkSession)
        small, rows = _small(rows, n)
        found = gathered(small.select("g", "t", "n", "d").repartition("g"), n, TASK_SETS).sortWithinPartitions("g")
        found = cut(_within(found, num, den))
        rows = cut(gathered(rows, n, TASK_SETS))
        n = rows.count()
        if not n:
            return cut(few(connected_components(found))) if roots is None else _joined(roots, found, every)
        each = rows.select("g", "m", F.explode("d").alias("e")).groupBy("g", "e").agg(F.count(F.lit(1)).alias("f"), F.first("m").alias("m"))
        most = each.where("2 * f > m").groupBy("g").agg(F.collect_list("e").alias("c"), F.first("m").alias("m"))
        apart = _with(rows, most).withColumn("d", _either(F.col("d"), F.coalesce("c", F.array().cast("array<long>")))).drop("c")
        apart = cut(gathered(apart.withColumn("w", more * F.size("d") - less * F.col("n")), n, TASK_SETS))
        least = apart.groupBy("g").agg(F.min(F.struct("w", "t")).alias("low"), F.first("m").alias("m"))
        near = cut(few(_with(apart.select("g", "t", "m", "w", F.size("d").alias("k")), least, "inner")))
        new = near.where(F.col("w") + F.col("low.w") <= 0).where(F.col("t") != F.col("low.t")).select(F.col("t").alias("a"), F.col("low.t").alias("b"))
        new = new.unionByName(found)
        roots = cut(few(connected_components(new))) if roots is None else _joined(roots, new, max(n, every))
        # all roots are read, however few rows are left
        few = lambda df, n=max(n, every): gathered(df, n)
        # in up to three rows no element of a difference is in two
        root = lambda c: roots.select(F.col("node").alias("t"), F.col("root").alias(c))
        left = few(near.where("m > 3").join(root("_own"), "t", "left")).withColumn("root", F.coalesce("_own", "t")).drop("_own")
        left = left.join(root("low_root").withColumnRenamed("t", "_low"), F.col("low.t") == F.col("_low"), "left").withColumn("low_root", F.coalesce("low_root", "low.t")).drop("_low")
        left = cut(few(left))
        # the least w that a row of another group has; two of one group need no look
        others = left.where("root != low_root").groupBy("g").agg(F.min("w").alias("w_else"), F.first("m").alias("m"))
        bound = F.when(F.col("root") == F.col("low_root"), F.col("w_else")).otherwise(F.col("low.w"))
        common = F.greatest(F.lit(1), F.ceil((F.col("w") + bound) / (2 * more)))
        asked = cut(few(_with(left, others, "inner").select("g", "t", "root", "k", (F.col("k") - common + 1).alias("p")).where("p > 0")))
        elements = asked.agg(F.sum("k")).first()[0]
        if not elements:
            return roots
        parts = gathered(apart.select("g", "t", "d").join(asked, ["g", "t"]), n, TASK_SETS).select("g", "t", "root", "k", "p", F.explode("d").alias("e"))
        parts = gathered(parts.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("g", "e"))), elements).where("f > 1")
        own = Window.partitionBy("g", "t")
        at = F.row_number().over(own.orderBy("f", "e")) + F.col("k") - F.count(F.lit(1)).over(own)
        rarest = cut(gathered(parts.withColumn("at", at), elements).where("at <= p").select("g", "e", "t", "root"))
        lists = rarest.groupBy("g", "e").agg(*_same_rows(), F.min("root").alias("one"), F.max("root").alias("other")).where("one != other")
        once = lists.groupBy("n", "x", "y").agg(F.min(F.struct("g", "e")).alias("l")).select("l.g", "l.e", F.col("n").alias("m"), F.monotonically_increasing_id().alias("q"))
        once = cut(gathered(once, elements))
        before, n = n, once.agg(F.sum("m")).first()[0]
        if not n:
            return roots
        inside = rarest.select("g", "e", "t").join(once, ["g", "e"])
        # all differences are read for the few that go on: tasks by what goes in, then by what came out
        rows = inside.join(apart.select("g", "t", "n", "d"), ["g", "t"]).select(F.col("q").alias("g"), "t", "m", "n", "d")
        rows = gathered(cut(gathered(rows, max(before, n), TASK_SETS)), n, TASK_SETS)
