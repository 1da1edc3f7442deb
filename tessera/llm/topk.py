"""Exact top-k by inner product over norm-sorted blocks.

Vectors are rotated by the right singular vectors of a bounded sample, which moves their length into the
first dimensions, and are sorted by descending length into blocks of at most ``BLOCK`` vectors. Every query
first meets a head of the longest vectors, which gives it a lower bound for its k-th score. A block whose
longest vector times the length of the query stays below that bound is skipped whole (Cauchy-Schwarz).
In the others, the product over the first rotated dimensions plus the product of the lengths of the rest
bounds each score; pairs that can still reach the bound are scored exactly. Rotation and bounds
only ever skip; scores are sums of whole numbers.

Queries meet all rows in blocks. The blocks of vectors that the bounds of a block of queries do not exclude are
dealt over tasks in bands of ``BAND``; a task takes its band by descending length, raises the bounds of its queries after
each block, skips what falls below them, and returns k rows a query. Equal rows travel once, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, light

BLOCK = 8192
HEAD = 2048
BAND = 16
#: Bound of the sample the rotation is fitted on. It changes the speed only.
ROTATION_SAMPLE = 4096
_PACKED = "dim int, block string, n int, longest double, ids binary, keys binary, copies binary, kind string, values binary"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dim, v, key, copies, norm2): floor(scale * x) per component, equal rows once with their number.

    Rows with a null id or vector, an empty vector, or a null or non-finite component take no part."""
    x = F.col("raw")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(F.coalesce(finite, F.lit(False)))
    rows = rows.select("id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    return rows.select("id", F.size("v").alias("dim"), "v", F.xxhash64("v").alias("key"), "copies", norm2.alias("norm2"))


def rotation(sample: np.ndarray) -> np.ndarray:
    return np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) else np.eye(sample.shape[1])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows: through floats while every sum stays exact in them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    products = q.astype(object) @ x.T.astype(object)
    return np.clip(products, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Positions, in order of (score descending, id ascending), of what makes up the k best, copies counted."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    at = at[np.lexsort((ids[at], -scores[at]))]
    return at[: int(np.searchsorted(np.cumsum(copies[at]), k)) + 1]


class Searcher:
    """The k best for a block of queries over blocks of vectors, each sorted by length, from a lower bound per query."""

    def __init__(self, turn: np.ndarray, k: int, partial: int, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, bar: np.ndarray):
        self.turn, self.k, self.p = turn, k, min(partial, q.shape[1])
        self.ids, self.keys, self.q, self.bar = ids, keys, q, bar.copy()
        self.norm = np.linalg.norm(q.astype(np.float64), axis=1)
        self.turned = q @ turn
        self.rest = np.linalg.norm(self.turned[:, self.p :], axis=1)
        none = np.zeros(0, dtype=np.int64)
        self.found = [(none, none, none)] * len(q)  # ids, scores, copies

    def meet(self, xid: np.ndarray, xkey: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
        turned = x @ self.turn
        rest = np.linalg.norm(turned[:, self.p :], axis=1)
        for s in range(0, len(self.q), 256):
            self._meet(slice(s, s + 256), xid, xkey, copies, x, norm, turned, rest)

    def _meet(self, part: slice, xid, xkey, copies, x, norm, turned, rest) -> None:
        bar, norm_q, q, p = self.bar[part], self.norm[part], self.q[part], self.p
        slack = 1e-9 * (norm_q * norm.max(initial=0)) + 1e-6
        reach = np.searchsorted(-norm, -((bar - slack) / np.maximum(norm_q, 1e-300)), side="right")
        reach = np.where(bar <= slack, len(x), reach)  # vectors are sorted by length: those behind cannot reach the bound
        far = int(reach.max(initial=0))
        if not far:
            return
        bound = self.turned[part, :p] @ turned[:far, :p].T + self.rest[part, None] * rest[None, :far]
        alive = (bound + slack[:, None] >= bar[:, None]) & (np.arange(far)[None, :] < reach[:, None])
        dense = exact_scores(q, x[:far]) if alive.mean() > 0.02 else None
        for i in range(len(q)):
            at = np.flatnonzero(alive[i])
            if not len(at):
                continue
            scores = dense[i, at] if dense is not None else exact_scores(q[i : i + 1], x[at])[0]
            ok = scores >= bar[i]
            at, scores = at[ok], scores[ok]
            n = np.minimum(copies[at], self.k + 1)
            # of the query's own row, its copies remain
            own = (xid[at] == self.ids[part][i]) & (xkey[at] == self.keys[part][i])
            own[own] = (x[at[own]] == q[i]).all(axis=1)
            n = np.where(own, n - 1, n)
            at, scores, n = at[n > 0], scores[n > 0], n[n > 0]
            if len(at):
                j = part.start + i
                ids, scores, n = (np.concatenate(pair) for pair in zip(self.found[j], (xid[at], scores, n)))
                top = best(scores, ids, n, self.k)
                self.found[j] = ids[top], scores[top], n[top]
                if n[top].sum() >= self.k:
                    self.bar[j] = max(self.bar[j], float(scores[top[-1]]))

    def result(self) -> tuple[np.ndarray, ...]:
        """(query id, query key, id, score, copies) of all that was found."""
        sizes = [len(f[0]) for f in self.found]
        return np.repeat(self.ids, sizes), np.repeat(self.keys, sizes), *[np.concatenate([f[c] for f in self.found]) for c in range(3)]


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _least_kind(v: np.ndarray) -> str:
    """The smallest type of whole numbers that holds all of ``v``."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _unpacked(r: dict) -> tuple[np.ndarray, ...]:
    ids, keys, copies = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "keys", "copies"))
    return ids, keys, copies, np.frombuffer(r["values"], dtype=r["kind"]).astype(np.int64).reshape(len(ids), -1)


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows in order of (dim, length descending, id), packed into blocks of at most ``size`` of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[np.ndarray, ...]] = []
        dim, count, made, part = None, 0, 0, TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            ids, v, norm2, keys, copies = (np.concatenate(x) for x in zip(*held))
            kind = _least_kind(v)
            values = {"dim": dim, "block": f"{part}:{made}", "n": len(ids), "longest": float(np.sqrt(norm2.max())), "ids": ids.tobytes(), "keys": keys.tobytes(), "copies": copies.tobytes(), "kind": kind, "values": v.astype(kind).tobytes()}
            types = (pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(values.values(), types)], names=list(values))

        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(dims):
                if held and (dim != dims[at] or count == size):
                    yield block()
                    held, count, made = [], 0, made + 1
                dim = int(dims[at])
                same = int(np.argmax(dims[at:] != dim)) or len(dims) - at if dims[-1] != dim else len(dims) - at
                n = min(same, size - count)
                some = batch.slice(at, n)
                held.append((some.column("id").to_numpy(zero_copy_only=False), _matrix(some, "v", dim), *[some.column(c).to_numpy(zero_copy_only=False) for c in ("norm2", "key", "copies")]))
                at, count = at + n, count + n
        if held:
            yield block()

    ordered = rows.repartitionByRange("dim", F.desc("norm2"), "id").sortWithinPartitions("dim", F.desc("norm2"), "id")
    return ordered.mapInArrow(run, _PACKED)


def topk(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, partial: int = 24, block: int = BLOCK, head: int = HEAD, band: int = BAND) -> DataFrame:
    """(query_id, rank, id, score): the k best rows for each row for which ``is_query`` (a condition on ``id``) holds.

    Ties go to the smaller id, a query's own row takes no part, and only vectors of the same dimension meet. An id given
    more than once is as many rows: each is a candidate for the others, and each that is a query has its ranks.
    A score beyond 64 bits is given as the nearest 64-bit number. An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    rows = cut(whole_vectors(vectors, id_col, vector_col, scale))
    spark = rows.sparkSession
    turns: dict[int, np.ndarray] = {}
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # one small model for each dimension that occurs; the tables of this engine have one
    for dim in [r["dim"] for r in rows.select("dim").distinct().orderBy("dim").collect()]:
        mine = rows.where(F.col("dim") == dim)
        top = mine.orderBy(F.desc("norm2"), "id", "key").limit(head).select("id", "v").toPandas()
        heads[dim] = (top["id"].to_numpy(dtype=np.int64), np.stack(top["v"].to_numpy()).astype(np.int64))
        some = mine.orderBy(F.xxhash64(F.lit("rotation"), "id", "key")).limit(ROTATION_SAMPLE).select("v").toPandas()
        turns[dim] = rotation(np.stack(some["v"].to_numpy()).astype(np.float64))
    shared = spark.sparkContext.broadcast((turns, heads))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with a bound for each: the k-th score in the head, without rows of its own id."""
        _, heads = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, _, _, q = _unpacked(row.to_pylist()[0])
                hid, hx = heads[row.column("dim")[0].as_py()]
                bar = np.full(len(q), -np.inf)
                for s in range(0, len(q) if len(hid) >= k else 0, 256):
                    scores = exact_scores(q[s : s + 256], hx)
                    scores[ids[s : s + 256, None] == hid[None, :]] = np.iinfo(np.int64).min
                    bar[s : s + 256] = np.partition(scores, len(hid) - k, axis=1)[:, len(hid) - k]
                bar[bar <= -(2.0**63)] = -np.inf
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                need = float(np.min(np.where(bar > 0, bar / np.maximum(norm, 1e-300), -np.inf), initial=np.inf))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([need * (1 - 1e-9)]), pa.array([bar.tobytes()], type=pa.binary())], names=[*row.schema.names, "need", "bar"])

    queries = cut(pack(rows.where(is_query), block // 4).mapInArrow(thresholds, _PACKED + ", need double, bar binary").withColumnRenamed("block", "qblock"))
    blocks = cut(pack(rows, block))
    # pairs of blocks, by their small descriptions, before any vector moves
    pairs = queries.select("dim", "qblock", "need").join(light(blocks.select("dim", "block", "longest")), "dim").where("longest >= need")
    bands = max(1, -(-blocks.count() // band))
    pairs = cut(pairs.select("dim", "qblock", "block", F.pmod(F.xxhash64("block"), F.lit(bands)).alias("band")))
    empty = F.lit(None).cast("binary").alias("bar")
    first = pairs.select("qblock", "band").distinct().join(queries, "qblock").select("qblock", "band", F.lit(0).alias("side"), "bar", *_packed_columns())
    then = pairs.select("qblock", "band", "block").join(blocks, "block").select("qblock", "band", F.lit(1).alias("side"), empty, *_packed_columns())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, _ = shared.value
        now: Searcher | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in now.result()], names=["query_id", "key", "id", "score", "copies"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, keys, copies, v = _unpacked(r)
                if r["side"] == 0:
                    yield from done()
                    now = Searcher(turns[r["dim"]], k, partial, ids, keys, v, np.frombuffer(r["bar"]))
                else:
                    now.meet(ids, keys, copies, v)
        yield from done()

    work = first.unionByName(then).repartition("qblock", "band").sortWithinPartitions("qblock", "band", "side", F.desc("longest"))
    found = work.mapInArrow(search, "query_id long, key long, id long, score long, copies long")
    each = found.select("query_id", "key", "id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id"))
    ranked = each.withColumn("rank", rank).where(F.col("rank") <= k).drop("copy")
    # equal rows that are queries have the same ranks each
    many = light(rows.where("copies > 1").where(is_query).select(F.col("id").alias("query_id"), "key", F.col("copies").alias("times")))
    repeated = ranked.join(many, ["query_id", "key"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    return repeated.select("query_id", "rank", "id", "score")


def _packed_columns() -> list[str]:
    return ["dim", "longest", "ids", "keys", "copies", "kind", "values"]
