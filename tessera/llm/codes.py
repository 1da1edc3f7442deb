"""Vector codes: product quantisation by a Lloyd iteration that filters codebook entries through kd-trees.

Vectors become whole numbers and are cut into parts. Every partition packs its rows into blocks and builds, once,
a kd-tree over each part of a block; a node caches the number and the sums of its points and the box around them.
In a round the entries of the codebook go down each tree: the entry nearest to the middle of a box stays, and
another is eliminated where even the corner of the box that favours it most is nearer to the first. A node with one
entry left gives all its points to it at once, by its cached number and sums; only points of leaves that keep
several entries are compared one by one. All nodes of a level go together through numpy.

Arithmetic is in whole numbers, so every assignment, ties included, is that of the plain comparison with all
entries: in 64 bits where the magnitudes allow it, else in Python's integers. Only sums per entry leave the
tasks in a round, and one small codebook for each dimension of vectors goes back.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, light, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of a block, for which a task holds the trees of all parts at once.
BLOCK = 16384
LEAF = 32
#: Labels up to which their sums are broadcast.
LABELS = 100_000


@dataclass
class Tree:
    """Nodes by level, children behind parents. ``points`` are in tree order, ``row`` is the row of each.

    ``low`` and ``high`` are the boxes, ``first`` and ``last`` the points of a node, ``child`` its left child or -1; the
    right child is the next one."""

    points: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A kd-tree that cuts a node at the median of its widest side until ``leaf`` points are left or all are equal."""
    row = np.arange(len(points))
    first, last, child = [0], [len(points)], []
    low, high, total = [], [], []
    i = 0
    while i < len(first):
        a, b = first[i], last[i]
        own = points[row[a:b]]
        low.append(own.min(axis=0) if b > a else np.zeros(points.shape[1], dtype=points.dtype))
        high.append(own.max(axis=0) if b > a else low[-1])
        total.append(own.sum(axis=0))
        sides = high[-1] - low[-1]
        if b - a <= leaf or not len(sides) or not sides.max() > 0:
            child.append(-1)
        else:
            half = (b - a) // 2
            order = np.argsort(own[:, int(np.argmax(sides))], kind="stable")
            row[a:b] = row[a:b][order]
            child.append(len(first))
            first += [a, a + half]
            last += [a + half, b]
        i += 1
    stack = lambda x: np.array(x, dtype=points.dtype).reshape(len(x), points.shape[1])
    return Tree(points[row], row, stack(low), stack(high), stack(total), np.array(first), np.array(last), np.array(child))


def _least(cost: np.ndarray) -> np.ndarray:
    """The place of the least value of each row, the first of equal ones; of Python's integers as well."""
    return np.argmin(cost, axis=1)


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each row, points per entry, sums per entry) for the nearest of ``entries``, ties to the lower index."""
    k = len(entries)
    chosen = np.zeros(len(tree.points), dtype=np.int64)
    count, total = np.zeros(k, dtype=np.int64), np.zeros_like(entries)
    square = (entries * entries).sum(axis=1)
    nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    places = np.arange(k)

    def settle(node: np.ndarray, entry: np.ndarray) -> None:
        """Whole subtrees, each to one entry."""
        size = tree.last[node] - tree.first[node]
        np.add.at(count, entry, size)
        np.add.at(total, entry, tree.total[node])
        at = np.repeat(tree.first[node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        chosen[tree.row[at]] = np.repeat(entry, size)

    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        # the entry nearest to the middle of each box; distances to it are taken at twice the size
        middle = low + high
        cost = square[None, :] - middle @ entries.T  # |2z - (low + high)|^2 / 4 without what all entries share
        worst = cost.max() + 1
        near = _least(np.where(left, cost, worst))
        away = entries[None, :, :] - entries[near][:, None, :]
        # the corner of the box that favours an entry most against the near one
        corner = np.maximum(away * low[:, None, :], away * high[:, None, :]).sum(axis=2)
        lead = square[None, :] - square[near][:, None] - 2 * corner  # by how much the near one wins at least
        out = (lead > 0) | ((lead == 0) & (places[None, :] > near[:, None]))
        out[np.arange(len(nodes)), near] = False
        left = left & ~out.astype(bool)
        single = left.sum(axis=1) == 1
        if single.any():
            settle(nodes[single], near[single])
        nodes, left = nodes[~single], left[~single]
        leaf = tree.child[nodes] < 0
        if leaf.any():
            ends, mine = nodes[leaf], left[leaf]
            size = tree.last[ends] - tree.first[ends]
            at = np.repeat(tree.first[ends] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            points = tree.points[at]
            cost = square[None, :] - 2 * (points @ entries.T)
            entry = _least(np.where(np.repeat(mine, size, axis=0), cost, cost.max() + 1))
            chosen[tree.row[at]] = entry
            np.add.at(count, entry, 1)
            np.add.at(total, entry, points)
        down = tree.child[nodes[~leaf]]
        nodes = np.stack([down, down + 1], axis=1).ravel()
        left = np.repeat(left[~leaf], 2, axis=0)
    return chosen, count, total


def small_enough(most: int, dim: int) -> bool:
    """Whether squared distances between vectors of this magnitude, and sums over a block, stay within 64 bits."""
    return 16 * max(dim, 1) * most * most < 2**62 and most * BLOCK < 2**62


def _magnitude(v: np.ndarray) -> int:
    return max(abs(int(v.min())), abs(int(v.max()))) if v.size else 0


def whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, dim, v): floor(scale * x) of every component, in 64 bits; rows with a null or non-finite one are dropped."""
    x = F.col("raw")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    rows = rows.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("id", "label", F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def first_entries(rows: DataFrame, entries: int) -> dict[int, list[list[int]]]:
    """By dimension, the ``entries`` vectors with the smallest ids; ties go by the vector, rows without an id come last."""
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.asc_nulls_last("id"), "v"))
    found: dict[int, list[list[int]]] = {}
    for r in rows.select("dim", "id", "v").withColumn("r", rank).where(F.col("r") <= entries).orderBy("dim", "r").collect():
        found.setdefault(r["dim"], []).append(list(r["v"]))
    return found


def _cut(v: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts; where the dimension can't be divided, the first ones have one component more."""
    return np.array_split(v, parts, axis=1)


def _stored(tree: Tree) -> Tree:
    """With points and boxes in the smallest whole numbers that hold them."""
    kind = next((t for t in (np.int16, np.int32) if tree.points.dtype != object and _magnitude(tree.points) <= np.iinfo(t).max), None)
    return _as(tree, kind, ("points", "low", "high")) if kind else tree


def _as(tree: Tree, kind, names: tuple[str, ...]) -> Tree:
    return replace(tree, **{n: getattr(tree, n).astype(kind) for n in names})


def trees(rows: DataFrame, parts: int, block: int, leaf: int) -> DataFrame:
    """(dim, ids, labels, trees): blocks of rows of one dimension, in the order they are read, with a tree for each part."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size: dict[int, int] = {}

        def packed(dim: int) -> pa.RecordBatch:
            some = pa.Table.from_batches(held.pop(dim)).combine_chunks()
            n = size.pop(dim)
            v = some.column("v").chunk(0).flatten().to_numpy().reshape(n, dim) if dim else np.zeros((n, 0), dtype=np.int64)
            if not small_enough(_magnitude(v), dim):
                v = v.astype(object)
            built = pickle.dumps([_stored(build(p, leaf)) for p in _cut(v, parts)], protocol=5)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], type=pa.int32()), some.column(c).chunk(0)) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([pa.array([dim], type=pa.int32()), *lists, pa.array([built], type=pa.binary())], names=["dim", "ids", "labels", "trees"])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                while mine.num_rows:
                    n = min(mine.num_rows, block - size.get(dim, 0))
                    held.setdefault(dim, []).append(mine.slice(0, n))
                    size[dim] = size.get(dim, 0) + n
                    mine = mine.slice(n)
                    if size[dim] == block:
                        yield packed(dim)
            if sum(size.values()) > 4 * block:  # many dimensions at once
                for dim in list(held):
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return rows.mapInArrow(run, f"dim int, ids array<long>, labels array<{label}>, trees binary")


Codebooks = dict[int, list[list[list[int]]]]  # by dimension: part, entry, component


def _assigned(data: bytes, codebook: list[list[list[int]]]) -> Iterator[tuple[Tree, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for tree, entries in zip(pickle.loads(data), codebook):
        z = np.array(entries, dtype=object).reshape(len(entries), tree.points.shape[1])
        small = tree.points.dtype != object and small_enough(_magnitude(z), z.shape[1])
        kind = np.int64 if small else object
        tree, z = _as(tree, kind, ("points", "low", "high", "total")), z.astype(kind)
        yield tree, z, *assign(tree, z)


def moved(blocks: DataFrame, now: Codebooks) -> Codebooks:
    """A round: every entry becomes the floor of the mean of what is nearest to it; unused ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, data in zip(batch.column("dim").to_pylist(), batch.column("trees")):
                found = [(dim, p, e, c, int(s), int(n)) for p, (_, _, _, count, total) in enumerate(_assigned(data.as_buffer(), now[dim])) for e, n in enumerate(count) if n for c, s in enumerate(total[e])]
                columns = list(zip(*found)) or [()] * 6
                types = [*[pa.int32()] * 4, pa.decimal128(38, 0), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["dim", "part", "entry", "place", "total", "n"])

    sums = blocks.select("dim", "trees").mapInArrow(run, "dim int, part int, entry int, place int, total decimal(38,0), n long")
    then = {dim: [[list(z) for z in part] for part in parts] for dim, parts in now.items()}
    for r in sums.groupBy("dim", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # a row a component
        then[r["dim"]][r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return then


def codebooks(blocks: DataFrame, start: dict[int, list[list[int]]], parts: int, rounds: int) -> Codebooks:
    now = {dim: [p.tolist() for p in _cut(np.array(v, dtype=object).reshape(len(v), dim), parts)] for dim, v in start.items()}
    for _ in range(rounds):
        now = moved(blocks, now)
    return now


def digest(codebook: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(c) for part in codebook for entry in part for c in entry).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(id, label, dim, codes, error, label_error, digest): one row per kept vector; ``codes`` has an entry for each part.

    Rows whose vector is null or holds a null or non-finite component are dropped. Vectors of different dimensions
    have codebooks of their own; a dimension that can't be divided gives its first parts one component more. The first
    entries are the vectors with the smallest ids (ties by the vector, rows without an id last), fewer if there are
    fewer. Repeated rows are as many points. ``label_error`` sums over equal labels, nulls together. Components
    beyond 64 bits after scaling, and errors beyond it, count as the nearest 64-bit number. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    rows = cut(whole(vectors, id_col, vector_col, label_col, scale))
    blocks = stored(trees(rows, parts, block, leaf), "code-trees")
    final = codebooks(blocks, first_entries(rows, entries), parts, rounds)
    digests = {dim: digest(c) for dim, c in final.items()}
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                ids = batch.column("ids")[i].values
                codes = np.zeros((len(ids), parts), dtype=np.int32)
                error = np.zeros(len(ids), dtype=object)
                for p, (tree, z, chosen, _, _) in enumerate(_assigned(batch.column("trees")[i].as_buffer(), final[dim])):
                    codes[:, p] = chosen
                    apart = tree.points - z[chosen[tree.row]]
                    error[tree.row] += (apart * apart).sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
                error = pa.array([min(int(e), 2**63 - 1) for e in error], type=pa.int64())
                yield pa.RecordBatch.from_arrays([ids, batch.column("labels")[i].values, pa.array([dim] * len(ids), type=pa.int32()), lists, error, pa.array([digests[dim]] * len(ids), type=pa.string())], names=["id", "label", "dim", "codes", "error", "digest"])

    coded = cut(blocks.mapInArrow(run, f"id long, label {label}, dim int, codes array<int>, error long, digest string"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    summed = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    by = light(summed.withColumnRenamed("label", "of"), LABELS)
    return coded.join(by, F.col("label").eqNullSafe(F.col("of"))).drop("of")
