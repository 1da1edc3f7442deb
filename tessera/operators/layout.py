"""A layout of vectors in the plane that keeps neighbourhoods: fuzzy neighbour graph, then forces by rounds of joins.

Each row gives its nearest rows weights that fall with the distance beyond the nearest, so that they sum to the logarithm
of their number; the two directions of a pair join as probabilities. Places begin at the two main directions of a bounded sample. In
a round an edge pulls its ends together with the probability of its weight, and rows that a hash puts into one small
bucket push each other away. Choices come from hashes of rows and round, and forces are summed in whole numbers, so the
result does not depend on the order in which rows meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.density import Blocks, neighbours
from tessera.operators.lineage import checkpointed

#: The curve 1 / (1 + A d^2B) for a least distance of 0.1, and the least and most neighbours.
A, B = 1.577, 0.895
MOST_NEIGHBOURS, LEAST_NEIGHBOURS = 15, 2
#: Bound of the rows from which the main directions come.
SAMPLE = 2048
ROUNDS = 24
BUCKET = 6
#: Part of a pull that is taken, as all edges of a row pull at once and only a few others push it.
PULL = 0.1
_UNIT = 1 << 24


def neighbour_count(rows: int) -> int:
    return min(MOST_NEIGHBOURS, max(LEAST_NEIGHBOURS, rows // 5))


def fuzzy_edges(near: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the union of what either end gives the other."""

    @F.pandas_udf("array<double>")
    def weights(distances):
        import pandas as pd

        out = []
        for d in distances:
            d = np.sqrt(np.asarray(d, dtype=np.float64))
            over = np.maximum(d - d.min(), 0.0)
            low, high, goal = 0.0, max(float(over.max()), 1e-12) * 64, np.log2(max(len(d), 2))
            for _ in range(48):
                mid = (low + high) / 2
                low, high = (mid, high) if np.exp(-over / mid).sum() < goal else (low, mid)
            out.append(np.exp(-over / high))
        return pd.Series(out)

    rows = near.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("rank", "near", "d2"))).alias("l"))
    each = rows.select("n", F.explode(F.arrays_zip(F.transform("l", lambda x: x["near"]).alias("near"), weights(F.transform("l", lambda x: x["d2"])).alias("w"))).alias("e"))
    pair = each.select(F.least("n", "e.near").alias("a"), F.greatest("n", "e.near").alias("b"), F.col("e.w").alias("w"))
    return pair.groupBy("a", "b").agg((F.max("w") + F.when(F.count("w") == 2, F.min("w") * (1 - F.max("w"))).otherwise(0.0)).alias("w"))


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(-4.0), F.least(F.lit(4.0), x))


def main_directions(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Middle and the two directions of most variance of at most ``SAMPLE`` rows (n, v)."""
    some = np.array([r["v"] for r in rows.orderBy(F.xxhash64(F.lit("layout"), "n")).limit(SAMPLE).collect()])
    middle = some.mean(axis=0)
    turn = np.linalg.svd(some - middle, full_matrices=True)[2][:2]
    turn = turn * np.where(turn[np.arange(len(turn)), np.abs(turn).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    if len(turn) < 2:
        turn = np.concatenate([turn, np.zeros((2 - len(turn), turn.shape[1]))])
    return middle, turn


def projected(rows: DataFrame) -> DataFrame:
    """(n, x, y): the rows (n, v) along their two main directions, within about -10 to 10."""
    middle, turn = main_directions(rows)
    along = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in turn[k]]), lambda a, b: a * b), F.lit(-float(middle @ turn[k])), lambda s, x: s + x) for k in (0, 1)]
    flat = checkpointed(rows.select("n", along[0].alias("x"), along[1].alias("y")))
    reach = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first()["m"] or 1.0
    return flat.select("n", (F.col("x") * 10 / reach).alias("x"), (F.col("y") * 10 / reach).alias("y"))


def laid_out(rows: DataFrame, blocks: Blocks, rounds: int = ROUNDS, near: DataFrame | None = None) -> DataFrame:
    """(n, x, y) for rows (n, v) in ``blocks``: close rows end up close, groups apart. ``near`` are ``MOST_NEIGHBOURS`` or
    more ``neighbours`` of each, if they are known."""
    count = rows.count()
    k = neighbour_count(count)
    edges = checkpointed(fuzzy_edges(neighbours(blocks, k) if near is None else near.where(F.col("rank") <= k)))
    jitter = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "n"), F.lit(1000)) / 1e5
    at = checkpointed(projected(rows).select("n", (F.col("x") + jitter("x")).alias("x"), (F.col("y") + jitter("y")).alias("y")))
    buckets = max(1, count // BUCKET)
    for r in range(rounds):
        side = lambda c: at.select(F.col("n").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}"))
        drawn = edges.where(F.pmod(F.xxhash64("a", "b", F.lit(r)), F.lit(_UNIT)) < F.col("w") * _UNIT)
        pulled = drawn.join(side("a"), "a").join(side("b"), "b").withColumn("pull", F.lit(True))
        dealt = at.withColumn("_k", F.pmod(F.xxhash64("n", F.lit(r), F.lit("push")), F.lit(buckets)))
        one = dealt.select("_k", F.col("n").alias("a"), F.col("x").alias("x_a"), F.col("y").alias("y_a"))
        other = dealt.select("_k", F.col("n").alias("b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"))
        pushed = one.join(other, "_k").where("a < b").withColumn("pull", F.lit(False))
        met = pulled.select("a", "b", "x_a", "y_a", "x_b", "y_b", "pull").unionByName(pushed.select("a", "b", "x_a", "y_a", "x_b", "y_b", "pull"))
        d2 = F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2)
        met = met.withColumn("d2", d2)
        curve = 1 + A * F.pow("d2", F.lit(B))
        pull = F.when(F.col("d2") > 0, -2 * PULL * A * B * F.pow("d2", F.lit(B - 1)) / curve).otherwise(0.0)
        push = 2 * B / ((0.001 + F.col("d2")) * curve)
        size = F.when(F.col("pull"), pull).otherwise(push)
        step = [F.round(_clipped(size * (F.col(f"{c}_a") - F.col(f"{c}_b"))) * _UNIT).cast("long").alias(f"f{c}") for c in "xy"]
        forces = met.select("a", "b", *step).select(F.explode(F.array(F.struct(F.col("a").alias("n"), "fx", "fy"), F.struct(F.col("b").alias("n"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")))).alias("f"))
        total = forces.groupBy("f.n").agg(F.sum("f.fx").alias("fx"), F.sum("f.fy").alias("fy"))
        rate = 1.0 - r / rounds
        moved = [(F.col(c) + rate * _clipped(F.coalesce(f"f{c}", F.lit(0)) / _UNIT)).alias(c) for c in "xy"]
        at = checkpointed(at.join(total, "n", "left").select("n", *moved))
    return at


def kept_neighbours(at: DataFrame, near: DataFrame, k: int, block: int = 512) -> float:
    """Share of the ``k`` nearest in ``near`` (n, near) that are among the ``k`` nearest in the plane."""
    from tessera.operators.density import blocked

    flat = checkpointed(at.select("n", F.array("x", "y").alias("v")))
    found = neighbours(blocked(flat, block), k).select("n", "near")
    both = near.select("n", "near").join(found, ["n", "near"]).count()
    return both / max(near.count(), 1)
