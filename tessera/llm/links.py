"""Links among rows that share keys, without all pairs of a key.

``spanned`` gets keys with the rows that have them and a check of pairs. In a round every key compares its rows with
one of them, its centre, and drops it; what the links have joined by then needs no comparison any more. Keys whose
rows are all of one group are done, keys with the same rows count once. As soon as the pairs between different groups
that are left are few for the number of rows, all of them are checked; or, after ``CENTRES`` rounds, those that a cheaper look at
the rows of a key leaves. So the groups are exactly those that all pairs of each key would give, while a family of copies
costs each of its members a comparison or two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, light
from tessera.llm.components import connected_components

#: Rounds with centres before the pairs that are left are checked whatever their number.
ROUNDS = 12
#: Rounds with centres before a cheaper look at the rows of a key takes over: a first centre may join few of its family.
CENTRES = 3
#: Pairs for each row of the open keys that are few enough to check all of them.
FEW = 2
LEAST = 20_000


def _same_rows() -> list[Column]:
    """Aggregates that tell sets of rows apart: their number and two sums of hashes without an order."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("t")).alias("x"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("y")]


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _once(groups: DataFrame) -> DataFrame:
    """One key for each set of rows."""
    return groups.groupBy("n", "x", "y").agg(F.min(F.struct("key", "centre")).alias("g")).select("g.key", F.col("g.centre.t").alias("centre"))


def spanned(members: DataFrame, check: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of all rows linked to another, over links that join the same groups as all pairs would.

    ``members`` has (key long, t long, d): a row ``t`` under a key once, with the same ``d`` everywhere, which says how
    likely it is a good centre. ``check`` keeps those pairs (a, b) that are links. ``within``, if given, gets rows (key, t, of)
    and gives the pairs (a, b), a < b, under one key and with different ``of`` that may be links.
    """
    spark = members.sparkSession
    members = cut(members.select("key", "t", "d"))
    first = cut(members.groupBy("key").agg(*_same_rows(), F.min(F.struct("d", "t")).alias("low"), F.max(F.struct("d", "t")).alias("centre")).where("n > 1"))
    two = first.where("n = 2").select(*_ordered(F.col("low.t"), F.col("centre.t"))).distinct()
    kept = light(_once(first.where("n > 2")))
    open_rows = cut(members.join(kept, "key"))
    starred = open_rows.where("t != centre").select(*_ordered(F.col("t"), F.col("centre")))
    checked = cut(two.unionByName(starred).distinct())
    links = cut(check(checked))
    for n in range(rounds):
        roots = cut(connected_components(links))
        left = open_rows.where("t != centre").drop("centre").join(roots, F.col("t") == F.col("node"), "left").select("key", "t", "d", F.coalesce("root", "t").alias("of"))
        by = left.groupBy("key", "of").agg(*_same_rows(), F.max(F.struct("d", "t")).alias("centre"))
        groups = by.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max("centre").alias("centre")).where("groups > 1")
        groups = cut(groups)
        pairs, rows = groups.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not rows:
            return roots
        open_rows = cut(left.join(light(_once(groups)), "key"))
        last = pairs <= max(LEAST, FEW * rows) or n == rounds - 1 or (within is not None and n == CENTRES)
        if last and within is not None:
            asked = within(open_rows.select("key", "t", "of"))
        elif last:
            one, other = open_rows.select("key", "t", "of"), open_rows.select("key", F.col("t").alias("u"), F.col("of").alias("of_u"))
            asked = one.join(other, "key").where("of < of_u").select(*_ordered(F.col("t"), F.col("u")))
        else:
            of_centre = open_rows.where("t = centre").select("key", F.col("of").alias("of_centre"))
            asked = open_rows.join(of_centre, "key").where("of != of_centre").select(*_ordered(F.col("t"), F.col("centre")))
        asked = cut(asked.distinct().join(checked, ["a", "b"], "left_anti"))
        links = cut(links.unionByName(check(asked)))
        if last:
            break
        checked = checked.unionByName(asked)
        open_rows = open_rows.drop("of")
    return cut(connected_components(links))
