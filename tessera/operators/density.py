"""Density clusters of vectors: minimum spanning tree, condensed tree, leaf selection, and noise.

The spanning tree is Euclidean: with one sample for the core distance, mutual reachability is the distance. It is built by
Borůvka rounds. Edges are ordered by (distance, ends), so the tree is unique and so are the clusters. Rounds go by each
row's nearest rows, found once: the least edge that leaves a set is known from these wherever it is shorter than all that
the lists of the set's rows leave out. Vectors are compared again only when no set is sure of its edge, for the rows whose
lists are too short, and what that finds is kept. Vectors meet in pairs of groups of blocks: a pass moves each of them once
for each group, whatever their distances are.

A cluster is a leaf of the condensed tree: a set that has reached the least size, as it is just before it meets another
such set. A second run of rounds over the tree's edges lets only sets below the least size pick their least edge. That
never takes an edge at which two sets of the least size meet, and ends with at most (rows / least size) sets; the few edges
between those come to the driver. For every row the heaviest edge on the way to the ends of these edges is the heaviest
pick above both in the rounds, so sizes at any time are counts over rows. No step gathers the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import bounded_batches, checkpointed

#: Rows of a block.
BLOCK = 512
#: Bound on the bytes of vectors in a group of blocks, unless one block has more; a task holds two groups.
GROUP_BYTES = 64 << 20
#: Blocks that a block is compared with at once.
TILE = 4
#: Nearest rows by which the rounds of the spanning tree go. It changes the speed only.
NEAR = 15
#: Bound on the vectors that cells of near rows are laid around. It changes the speed only.
CELLS = 256
LEAST_ROWS = 4


def numbered(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(n, id, v) in the order of the ids: rows with an id and a whole vector of finite numbers, equal ids once.

    Vectors of another dimension than that of the smallest id take no part."""
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & x.isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)) & (F.size(x) > 0)).groupBy("id").agg(F.min("v").alias("v"))
    rows = checkpointed(rows)
    first = rows.agg(F.min_by(F.size("v"), "id").alias("dim")).first()["dim"]
    rows = rows.where(F.size("v") == F.lit(first or 0)).repartitionByRange("id").sortWithinPartitions("id")
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("n"), "id", "v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Blocks:
    """``rows``: (block, n array<long>, v array<double>, centre array<double>, radius), blocks numbered from 0 and near ones in a row."""

    rows: DataFrame
    place: DataFrame  # (n, block, pos)
    count: int
    dim: int
    size: int  # most rows of a block

    def groups(self, least: int) -> int:
        """Number of groups of blocks: ``least``, more if a group would have too many bytes, not more than blocks."""
        each = max(1, GROUP_BYTES // (8 * self.dim * self.size))
        return max(1, min(self.count, max(least, -(-self.count // each))))


def blocked(rows: DataFrame, block: int = BLOCK, cells: int = CELLS) -> Blocks:
    """Rows around the nearest of a few of them, from near to far, cut into blocks of at most ``block``."""
    bounded_batches(rows.sparkSession)
    # cells of at least two full blocks, so that few blocks stay nearly empty
    cells = max(1, min(cells, rows.count() // (2 * block)))
    some = rows.orderBy(F.xxhash64(F.lit("cells"), "n")).limit(cells).select("v").collect()
    centres = np.array([r["v"] for r in some])
    dim = centres.shape[1]
    square = (centres**2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            cell = np.argmin(square[None, :] - 2 * v @ centres.T, axis=1)
            far = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), batch.column("n"), batch.column("v")], names=["cell", "far", "n", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, count, cell = TaskContext.get().partitionId(), 0, [], 0, None

        def packed() -> pa.RecordBatch:
            n, v = np.concatenate([x.column("n").to_numpy() for x in held]), np.concatenate([_matrix(x.column("v"), dim) for x in held])
            centre = v.mean(axis=0)
            radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max())
            values = [part, made, n.tolist(), v.ravel().tolist(), centre.tolist(), radius]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(values, types)], names=["part", "made", "n", "v", "centre", "radius"])

        for batch in batches:
            kinds = batch.column("cell").to_numpy()
            at = 0
            while at < len(kinds):
                if held and (kinds[at] != cell or count == block):
                    yield packed()
                    held, count, made = [], 0, made + 1
                cell = int(kinds[at])
                size = min(int(np.searchsorted(kinds[at:], cell, side="right")), block - count)
                held.append(batch.slice(at, size))
                at, count = at + size, count + size
        if held:
            yield packed()

    near = rows.select("n", "v").mapInArrow(assign, "cell int, far double, n long, v array<double>")
    made = near.repartitionByRange("cell", "far", "n").sortWithinPartitions("cell", "far", "n").mapInArrow(pack, "part int, made int, n array<long>, v array<double>, centre array<double>, radius double")
    made = checkpointed(made)
    counts = {r["part"]: r["count"] for r in made.groupBy("part").count().collect()}  # a row a task
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = rows.sparkSession.createDataFrame(before, "part int, _before long")
    numbered_blocks = made.join(F.broadcast(offsets), "part").select((F.col("_before") + F.col("made")).alias("block"), "n", "v", "centre", "radius")
    place = checkpointed(numbered_blocks.select("block", F.posexplode("n").alias("pos", "n")))
    return Blocks(numbered_blocks, place, total, dim, block)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, the same whatever else is in the arrays and for either order."""
    return ((a - b) ** 2).sum(axis=1)


def _squares(a: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)


def _rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all pairs by one product, and how much less than the exact ones they may be taken for."""
    one, other = _squares(a), _squares(b)
    wide = np.concatenate([a, one[:, None], np.ones((len(a), 1))], axis=1)
    tall = np.concatenate([-2.0 * b, np.ones((len(b), 1)), other[:, None]], axis=1)
    return wide @ tall.T, 1e-9 * (one.max(initial=0.0) + other.max(initial=0.0)) + 1e-12


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (a[i], b[j])."""
    found = [_exact(a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    return np.concatenate(found) if found else np.zeros(0)


class _Nearest:
    """The ``k`` nearest rows so far of each of a number of rows, not beyond ``limit``, ties to the smaller number."""

    def __init__(self, n: np.ndarray, limit: np.ndarray, k: int):
        self.n, self.limit, self.k = n, limit, k
        self.d, self.near = np.full((len(n), k), np.inf), np.full((len(n), k), -1, dtype=np.int64)

    def add(self, i: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        ok = (near != self.n[i]) & (d <= self.limit[i])
        i, near, d = i[ok], near[ok], d[ok]
        if not len(i):
            return
        rows, which = np.unique(i, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), which])
        far, who = np.concatenate([self.d[rows].ravel(), d]), np.concatenate([self.near[rows].ravel(), near])
        order = np.lexsort((who, far, at))
        top = order[np.searchsorted(at[order], np.arange(len(rows)))[:, None] + np.arange(self.k)]
        self.d[rows], self.near[rows] = far[top], who[top]
        self.limit[rows] = np.minimum(self.limit[rows], self.d[rows, -1])

    def batch(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.near >= 0)
        return pa.RecordBatch.from_arrays([pa.array(self.n[i]), pa.array(self.near[i, j]), pa.array(self.d[i, j])], names=["n", "near", "d2"])


@dataclass
class _Block:
    """A block as a task has it, with what else is known of its rows."""

    centre: np.ndarray
    radius: float
    v: np.ndarray
    more: dict

    def apart(self, other: _Block) -> float:
        """No two rows of both are nearer."""
        return max(0.0, float(np.sqrt(((self.centre - other.centre) ** 2).sum())) * (1 - 1e-9) - self.radius - other.radius - 1e-9)


def _taken(batches: Iterator[pa.RecordBatch], dim: int, arrays: tuple[str, ...]) -> dict[tuple[int, int], list[_Block]]:
    """The blocks of a task by (pair, side)."""
    found: dict[tuple[int, int], list[_Block]] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
            made = _Block(get("centre"), batch.column("radius")[r].as_py(), get("v").reshape(-1, dim), {c: get(c) for c in arrays})
            found.setdefault((batch.column("pair")[r].as_py(), batch.column("side")[r].as_py()), []).append(made)
    return found


def _tiles(block: _Block, others: list[_Block]) -> Iterator[list[_Block]]:
    """``others`` from near to far, a few at a time."""
    order = sorted(range(len(others)), key=lambda k: (block.apart(others[k]), k))
    for k in range(0, len(order), TILE):
        yield [others[x] for x in order[k : k + TILE]]


def neighbours(blocks: Blocks, k: int) -> DataFrame:
    """(n, near, d2, rank): the ``k`` nearest other rows of each row, ties to the smaller number; all, if fewer."""
    dim = blocks.dim

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with a bound on the distance of the k-th nearest of each row, from the block alone."""
        for batch in batches:
            for r in range(batch.num_rows):
                v = batch.column("v")[r].values.to_numpy().reshape(-1, dim)
                kth = np.full(len(v), np.inf)
                if len(v) > k:
                    rough, slack = _rough(v, v)
                    np.fill_diagonal(rough, np.inf)
                    kth = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(r, 1) for c in ("block", "n", "v", "centre", "radius")], pa.array([kth.tolist()], type=pa.list_(pa.float64()))], names=["block", "n", "v", "centre", "radius", "kth"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = _taken(batches, dim, ("n", "kth"))
        for pair in sorted({p for p, _ in taken}):
            sides = [taken[x] for x in sorted(taken) if x[0] == pair]
            own = len(sides) == 1
            best = [[_Nearest(b.more["n"], b.more["kth"], k) for b in side] for side in sides]
            index = {id(b): (s, x) for s, side in enumerate(sides) for x, b in enumerate(side)}
            for x, a in enumerate(sides[0]):
                mine = best[0][x]
                # within a group each two blocks meet once
                for tile in _tiles(a, sides[0][x:] if own else sides[1]):
                    theirs = [best[index[id(b)][0]][index[id(b)][1]] for b in tile]
                    least = [a.apart(b) ** 2 for b in tile]
                    kept = [y for y, d in enumerate(least) if d <= max(mine.limit.max(), theirs[y].limit.max())]
                    if not kept:
                        continue
                    v = np.concatenate([tile[y].v for y in kept])
                    n, limit = np.concatenate([theirs[y].n for y in kept]), np.concatenate([theirs[y].limit for y in kept])
                    rough, slack = _rough(a.v, v)
                    i, j = np.nonzero(rough <= mine.limit[:, None] + slack)
                    back = np.nonzero(rough <= limit[None, :] + slack)
                    mine.add(i, n[j], _distances(a.v, v, i, j))
                    i, j = back
                    d = _distances(a.v, v, i, j)
                    start = 0
                    for y in kept:
                        end = start + len(theirs[y].n)
                        if theirs[y] is not mine:
                            here = (j >= start) & (j < end)
                            theirs[y].add(j[here] - start, mine.n[i[here]], d[here])
                        start = end
            for side in best:
                for found in side:
                    yield found.batch()

    cores = blocks.rows.sparkSession.sparkContext.defaultParallelism
    groups = blocks.groups(int(np.ceil(np.sqrt(4 * cores))))
    own = F.floor(F.col("block") * groups / blocks.count).cast("int")
    low, high = F.least("side", "_h"), F.greatest("side", "_h")
    pair = (low * groups - F.floor(low * (low - 1) / 2) + high - low).cast("int")
    limited = blocks.rows.mapInArrow(inside, "block long, n array<long>, v array<double>, centre array<double>, radius double, kth array<double>")
    dealt = limited.withColumn("side", own).withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("pair", pair)
    dealt = dealt.select("pair", "side", "n", "v", "centre", "radius", "kth").repartitionById(groups * (groups + 1) // 2, "pair")
    found = dealt.mapInArrow(met, "n long, near long, d2 double")
    rank = F.row_number().over(Window.partitionBy("n").orderBy("d2", "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("n", "near", "d2", "rank")


def _nearest_outside(blocks: Blocks, of: DataFrame, asked: DataFrame) -> DataFrame:
    """(n, near, d2): for rows ``asked`` (n, limit) the nearest row of another set than theirs, ties to the smaller number;
    none if it is beyond ``limit``, a squared distance. ``of`` (n, set) has the sets of all rows."""
    dim = blocks.dim

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block only the rows that are asked for."""
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                at = get("at")
                values = [get("n")[at], get("v").reshape(-1, dim)[at].ravel(), get("sets")[at], get("limits")]
                lists = [pa.array([x.tolist()], type=pa.list_(t)) for x, t in zip(values, (pa.int64(), pa.float64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(r, 1), *lists, batch.column("centre").slice(r, 1), batch.column("radius").slice(r, 1)], names=["block", "n", "v", "sets", "limits", "centre", "radius"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = _taken(batches, dim, ("n", "sets", "limits"))
        for pair in sorted({p for p, side in taken if side == 0}):
            for a in taken[pair, 0]:
                best, sets = _Nearest(a.more["n"], a.more["limits"], 1), a.more["sets"]
                for tile in _tiles(a, taken.get((pair, 1), [])):
                    tile = [b for b in tile if a.apart(b) ** 2 <= best.limit.max() and not (sets.min() == sets.max() == b.more["sets"].min() == b.more["sets"].max())]
                    if not tile:
                        continue
                    v, n, other = np.concatenate([b.v for b in tile]), np.concatenate([b.more["n"] for b in tile]), np.concatenate([b.more["sets"] for b in tile])
                    rough, slack = _rough(a.v, v)
                    rough[sets[:, None] == other[None, :]] = np.inf
                    bound = np.minimum(best.limit, rough.min(axis=1) + slack) + slack
                    i, j = np.nonzero((rough <= bound[:, None]) & (rough < np.inf))
                    best.add(i, n[j], _distances(a.v, v, i, j))
                yield best.batch()

    cores = blocks.rows.sparkSession.sparkContext.defaultParallelism
    lists = blocks.place.join(of, "n").join(asked, "n", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "set", "limit"))).alias("_s"))
    open_ = F.filter("_s", lambda s: s["limit"].isNotNull())
    now = blocks.rows.join(lists, "block").withColumn("sets", F.transform("_s", lambda s: s["set"])).withColumn("at", F.transform(open_, lambda s: s["pos"])).withColumn("limits", F.transform(open_, lambda s: s["limit"])).drop("_s")
    now = checkpointed(now)
    left = checkpointed(now.where(F.size("at") > 0).mapInArrow(picked, "block long, n array<long>, v array<double>, sets array<long>, limits array<double>, centre array<double>, radius double"))
    count = left.agg(F.sum(F.size("n")).alias("c")).first()["c"]
    ones = max(1, -(-(count * 8 * dim) // GROUP_BYTES))
    others = blocks.groups(max(ones, -(-2 * cores // ones)))
    one = F.pmod("block", F.lit(ones)).cast("int")
    group = F.floor(F.col("block") * others / blocks.count).cast("int")
    asks = left.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda h: one * others + h)))
    rest = now.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ones - 1)), lambda h: h * others + group)))
    empty = F.array().cast("array<double>")
    both = asks.select("pair", F.lit(0).alias("side"), "n", "v", "sets", "limits", "centre", "radius").unionByName(rest.select("pair", F.lit(1).alias("side"), "n", "v", "sets", empty.alias("limits"), "centre", "radius"))
    found = both.repartitionById(ones * others, "pair").mapInArrow(met, "n long, near long, d2 double")
    least = found.groupBy("n").agg(F.min(F.struct("d2", "near")).alias("e"))
    return least.select("n", "e.near", "e.d2")


def _joined(picks: DataFrame, of: DataFrame) -> DataFrame:
    """(set, root): sets joined along ``picks`` (set, to), where two that pick each other are the only cycles. Sets without a
    pick are roots. Each round cuts the way to the root to a third."""
    own = of.select("set").distinct().join(picks, "set", "left").select("set", F.coalesce("to", "set").alias("to"))
    back = picks.select(F.col("set").alias("to"), F.col("to").alias("_back"))
    start = own.join(back, "to", "left").select("set", F.when((F.col("_back") == F.col("set")) & (F.col("set") < F.col("to")), F.col("set")).otherwise(F.col("to")).alias("to"))
    now = checkpointed(start)
    while True:
        over = now.select(F.col("set").alias("to"), F.col("to").alias("_over"))
        more = now.select(F.col("set").alias("_over"), F.col("to").alias("_more"))
        moved = checkpointed(now.join(over, "to").join(more, "_over").select("set", "to", F.col("_more").alias("_over")))
        now = moved.select("set", F.col("_over").alias("to"))
        if moved.where("to != _over").isEmpty():
            return now.withColumnRenamed("to", "root")


def spanning_tree(blocks: Blocks, near: DataFrame | None = None) -> DataFrame:
    """(d2, a, b): the edges of the minimum spanning tree, a < b; the order of edges is that of these columns.

    ``near`` are ``neighbours`` of the blocks, found here if they are not given. A set may join along its least known edge if
    that is shorter than ``beyond`` of all its rows, the least distance to any row that is not in a row's list."""
    near = checkpointed(neighbours(blocks, NEAR)) if near is None else near
    longest = near.agg(F.max("rank").alias("k")).first()["k"]
    edge = [F.col("d2"), F.least("n", "near").alias("a"), F.greatest("n", "near").alias("b")]
    left = near.select(*edge).distinct()
    # with fewer rows than a list has room for, all others are in it
    count = blocks.place.count()
    known = near.where(F.col("rank") == longest).select("n", F.col("d2").alias("beyond")) if longest and longest < count - 1 else near.where("false").select("n", F.col("d2").alias("beyond"))
    beyond = checkpointed(known)
    of = blocks.place.select("n", F.col("n").alias("set"))
    edges = None
    while True:
        side = lambda c: of.select(F.col("n").alias(c), F.col("set").alias(f"s_{c}"))  # noqa: B023, E731
        left = checkpointed(left.select("d2", "a", "b").join(side("a"), "a").join(side("b"), "b").where("s_a != s_b"))
        both = left.select(F.col("s_a").alias("set"), F.col("s_b").alias("to"), "d2", "a", "b").unionByName(left.select(F.col("s_b").alias("set"), F.col("s_a").alias("to"), "d2", "a", "b"))
        least = both.groupBy("set").agg(F.min(F.struct("d2", "a", "b", "to")).alias("e"))
        low = beyond.join(of, "n").groupBy("set").agg(F.min("beyond").alias("low"))
        sets = checkpointed(of.select("set").distinct().join(least, "set", "left").join(low, "set", "left"))
        if len(sets.take(2)) < 2:
            return left.select("d2", "a", "b") if edges is None else edges
        picks = sets.where("e is not null and (low is null or e.d2 < low)")
        if picks.isEmpty():
            limit = sets.select("set", F.coalesce("e.d2", F.lit(float("inf"))).alias("limit"))
            asked = checkpointed(beyond.join(of, "n").join(limit, "set").where("beyond <= limit").select("n", "limit"))
            found = checkpointed(_nearest_outside(blocks, of, asked))
            # no row that is not in the list is nearer than what was found, or than what was asked for
            again = asked.join(found, "n", "left").select("n", F.coalesce("d2", "limit").alias("beyond"))
            beyond = checkpointed(beyond.join(again.select("n"), "n", "left_anti").unionByName(again))
            new = found.select(*edge)
            to = new.join(side("a"), "a").join(side("b"), "b")
            more = to.select(F.col("s_a").alias("set"), F.col("s_b").alias("to"), "d2", "a", "b").unionByName(to.select(F.col("s_b").alias("set"), F.col("s_a").alias("to"), "d2", "a", "b"))
            # all sets know their least edge now, so all may join along it
            picks = both.unionByName(more.select(*both.columns)).groupBy("set").agg(F.min(F.struct("d2", "a", "b", "to")).alias("e"))
            left = left.select("d2", "a", "b").unionByName(new).distinct()
        picks = checkpointed(picks.select("set", "e.d2", "e.a", "e.b", "e.to"))
        new = picks.select("d2", "a", "b").distinct()
        edges = checkpointed(new if edges is None else edges.unionByName(new))
        of = checkpointed(of.join(_joined(picks.select("set", "to"), of), "set").select("n", F.col("root").alias("set")))


def _few_sets(edges: DataFrame, rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rounds in which sets of fewer than ``least`` rows join along their least edge, until there are none.

    Returns (n, set, levels) and the edges left between sets. ``levels`` has for each round the set of the row before it
    and the edge that set picked, null for none."""
    of = checkpointed(rows.select("n", F.col("n").alias("set"), F.array().cast("array<struct<set:bigint,e:struct<d2:double,a:bigint,b:bigint>>>").alias("levels")))
    left = edges
    while True:
        side = lambda c: of.select(F.col("n").alias(c), F.col("set").alias(f"s_{c}"))
        left = checkpointed(left.select("d2", "a", "b").join(side("a"), "a").join(side("b"), "b").where("s_a != s_b"))
        small = of.groupBy("set").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") < least).select("set")
        both = left.select(F.col("s_a").alias("set"), F.col("s_b").alias("to"), "d2", "a", "b").unionByName(left.select(F.col("s_b").alias("set"), F.col("s_a").alias("to"), "d2", "a", "b"))
        picks = both.join(small, "set", "left_semi").groupBy("set").agg(F.min(F.struct("d2", "a", "b", "to")).alias("p"))
        picks = checkpointed(picks.select("set", "p.to", F.struct("p.d2", "p.a", "p.b").alias("e")))
        if picks.isEmpty():
            return of, left
        root = _joined(picks.select("set", "to"), of)
        level = F.array_append("levels", F.struct("set", "e"))
        of = checkpointed(of.join(picks.select("set", "e"), "set", "left").join(root, "set").select("n", F.col("root").alias("set"), level.alias("levels")))


def _heaviest(one: Column, other: Column) -> Column:
    """The heaviest edge between two rows of one set: the greatest pick of either below the round in which their sets are one."""
    picks = F.zip_with(one, other, lambda x, y: F.when(x["set"] != y["set"], F.greatest(x["e"], y["e"])))
    return F.array_max(picks)


Edge = tuple[float, int, int]


def _leaves(edges: list[tuple[Edge, int, int]], apart: dict[tuple[int, int], Edge | None], sizes: dict[int, list[tuple[Edge | None, int]]], least: int) -> list[list[tuple[int, Edge]]]:
    """For each leaf, what its rows are near: (end, edge) says all rows of the end's set joined to it before the edge.

    ``edges``: the few edges between sets with their ends; ``apart``: the heaviest edge between two ends of one set;
    ``sizes``: for each end, how many rows of its set have which heaviest edge to it."""
    none: Edge = (-1.0, -1, -1)
    ends = sorted(sizes)

    def group(p: int, when: Edge) -> set[int]:
        """The ends in the set of ``p`` just before ``when``."""
        found, queue = {p}, [p]
        while queue:
            q = queue.pop()
            near = [r for r in ends if (q, r) in apart and (apart[q, r] or none) < when]
            near += [b if a == q else a for e, a, b in edges if e < when and q in (a, b)]
            new = [r for r in near if r not in found]
            found.update(new)
            queue += new
        return found

    def size(members: set[int], when: Edge) -> int:
        total, seen = 0, set()
        for p in sorted(members):
            if p not in seen:
                seen |= {r for r in members if (p, r) in apart and (apart[p, r] or none) < when}
                total += sum(c for e, c in sizes[p] if (e or none) < when)
        return total

    splits = [(e, a, b) for e, a, b in sorted(edges) if all(size(group(p, e), e) >= least for p in (a, b))]
    leaves = []
    for e, a, b in splits:
        for p in (a, b):
            members = group(p, e)
            if not any(f < e and (x in members or y in members) for f, x, y in splits):
                leaves.append([(r, e) for r in sorted(members)])
    return leaves


def density_clusters(vectors: DataFrame, id_col: str = "id", vector_col: str = "v", min_cluster_size: int | None = None, block: int = BLOCK, blocks: tuple[DataFrame, Blocks] | None = None, near: DataFrame | None = None) -> DataFrame:
    """(id, cluster): leaves of the condensed tree, numbered by their smallest ids from 0; rows of none are noise, -1.

    ``min_cluster_size`` is a fortieth of the rows, 2 at least, if not given. What the driver gets is bounded by
    (rows / min_cluster_size): the edges between that many sets. Fewer than 4 rows, or a tree without a
    split, are noise. Rows as in ``numbered``; ``near`` are ``neighbours`` of the blocks, if they are known."""
    rows = numbered(vectors, id_col, vector_col) if blocks is None else blocks[0]
    count = rows.count()
    if count < LEAST_ROWS:
        return rows.select("id", F.lit(-1).alias("cluster"))
    made = blocked(rows, block) if blocks is None else blocks[1]
    least = min_cluster_size or max(2, count // 40)
    of, left = _few_sets(spanning_tree(made, near), rows.select("n"), least)
    few = [((r["d2"], r["a"], r["b"]), r["a"], r["b"]) for r in left.select("d2", "a", "b").collect()]
    if not few:
        return rows.select("id", F.lit(-1).alias("cluster"))
    spark = rows.sparkSession
    ends = spark.createDataFrame([(p,) for p in sorted({p for _, a, b in few for p in (a, b)})], "n long")
    known = checkpointed(of.join(F.broadcast(ends), "n").select(F.col("n").alias("p"), "set", F.col("levels").alias("_levels")))
    met = checkpointed(of.join(F.broadcast(known), "set").select("n", "p", _heaviest(F.col("levels"), F.col("_levels")).alias("e")))
    edge = lambda e: None if e is None else (e["d2"], e["a"], e["b"])
    apart = {(r["p"], r["n"]): edge(r["e"]) for r in met.join(F.broadcast(ends), "n", "left_semi").collect()}
    # of the heaviest edges only their place among the few matters
    order = sorted(e for e, _, _ in few)
    listed = F.array(*[F.struct(F.lit(d).alias("d2"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for d, a, b in order])
    above = F.size(F.filter(listed, lambda t: F.col("e").isNotNull() & (t <= F.col("e"))))
    sizes: dict[int, list[tuple[Edge | None, int]]] = {}
    for r in met.select("p", above.alias("i")).groupBy("p", "i").count().collect():
        sizes.setdefault(r["p"], []).append((order[r["i"] - 1] if r["i"] else None, r["count"]))
    leaves = _leaves(few, apart, sizes, least)
    wanted = [(i, p, order.index(e)) for i, leaf in enumerate(leaves) for p, e in leaf]
    if not wanted:
        return rows.select("id", F.lit(-1).alias("cluster"))
    asked = spark.createDataFrame(wanted, "leaf int, p long, before int")
    own = met.select("n", "p", above.alias("i")).join(F.broadcast(asked), "p").where("i <= before").select("n", "leaf").distinct()
    own = checkpointed(rows.select("n", "id").join(own, "n", "left"))
    named = own.where("leaf is not null").groupBy("leaf").agg(F.min("id").alias("first")).orderBy("first").collect()  # a row a cluster
    number = spark.createDataFrame([(r["leaf"], k) for k, r in enumerate(named)], "leaf int, cluster int")
    return own.join(F.broadcast(number), "leaf", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_counts(clustered: DataFrame) -> DataFrame:
    """One row (clusters, noise, members): the number of clusters, of noise rows and of rows in clusters."""
    inside = F.col("cluster") >= 0
    return clustered.agg(F.count_distinct(F.when(inside, F.col("cluster"))).alias("clusters"), F.count_if(~inside).alias("noise"), F.count_if(inside).alias("members"))
