"""Minhashes of sets: keys of two collections, a byte of each, and the tables under which sets meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
_ROWS = 2048


class Collections:
    """Two collections of ``side`` keys of ``width`` minhashes each."""

    def __init__(self, side: int, width: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = 2 * side * width
        self.side, self.width = side, width
        self.mask = rng.integers(0, 2**64, n, dtype=np.uint64)
        self.factor = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """The keys of a set that isn't empty, those of the first collection before those of the second; a byte of each minhash."""
        least = np.full(len(self.mask), np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(hashes), _ROWS):
            mixed = hashes[k : k + _ROWS, None] ^ self.mask
            mixed ^= mixed >> np.uint64(32)
            mixed *= self.factor
            np.minimum(least, mixed.min(axis=0), out=least)
        small = (least >> np.uint64(8)).astype(np.uint8).tobytes()
        least = least.reshape(2 * self.side, self.width)
        out = np.zeros(2 * self.side, dtype=np.uint64)
        for j in range(self.width):
            out = (out ^ least[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64), small


def table_entries(texts: DataFrame, side: int) -> DataFrame:
    """(key, t, d): each set under the tables in which it can meet another; ``d`` grows with how many share its short keys."""
    short = texts.select("t", F.posexplode("keys").alias("i", "v"))
    again = short.groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = short.join(again, ["i", "v"]).groupBy("t").agg(F.collect_list(F.struct("i", "v")).alias("own"), F.floor(F.sum(F.log2("c")) * 16).alias("d"))
    first, second = F.filter("own", lambda e: e["i"] < side), F.filter("own", lambda e: e["i"] >= side)
    both = own.select("t", "d", F.explode(first).alias("a"), second.alias("b")).select("t", "d", "a", F.explode("b").alias("b"))
    return both.select(F.xxhash64("a.i", "a.v", "b.i", "b.v").alias("key"), "t", "d")
