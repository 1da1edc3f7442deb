"""Ranked lexical search with block-max pruning.

Documents are packed, in the order in which they are read, into blocks of at most ``BLOCK``. A block is a small
forward index of its range of documents, kept term by term, and holds for each term the largest impact that any
of its documents has. The weighted sum of these maxima bounds what a document of the block can score for a query.

Each query first meets the ``SEEDS`` blocks with its highest bounds, which gives it a k-th score to beat. Then
every task takes its blocks in bands, sorts them by the query's bound and scores them until the bound drops below
the k-th score known so far, which rises with each block. Bounds only ever skip; scores are whole numbers.

Only terms of the queries are indexed, but documents, their lengths and the counts of the terms come from all
documents. Queries go through in groups of at most ``QUERY_CHARS`` characters, so what is sent to the tasks (their
terms and weights) has a bound whatever the number of queries; each group reads the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

BLOCK = 512
#: A block ends at this many postings as well.
POSTINGS = 1 << 20
#: Blocks that a task holds at once, and postings that end a band as well.
BAND = 64
BAND_POSTINGS = 1 << 23
SEEDS = 3
QUERY_CHARS = 4_000_000
_INDEX = "block string, docs int, words long, ids array<long>, n array<long>, sizes array<int>, term binary, tf binary"
_BLOCKS = "block string, ids array<long>, postings int, term binary, most binary, starts binary, at binary, impact binary"
#: ASCII letters lower-cased, digits kept, other ASCII a gap; bytes of longer code points belong to terms.
_FOLDED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in (ord(chr(i).lower()) if i < 128 else i for i in range(256)))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none of a null text."""
    return text.translate(_FOLDED).split() if text else []


@dataclass(frozen=True)
class Queries:
    """Queries over term numbers: those of query i are ``term[ends[i-1]:ends[i]]``, each once, with its number of times."""

    vocabulary: dict[bytes, int]
    term: np.ndarray
    times: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        found = [Counter(terms(t)) for t in texts]
        term = [vocabulary.setdefault(w, len(vocabulary)) for c in found for w in c]
        times = [n for c in found for n in c.values()]
        return cls(vocabulary, np.array(term, dtype=np.int64), np.array(times, dtype=np.int64), np.r_[0, np.cumsum([len(c) for c in found])].astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1


@dataclass(frozen=True)
class Statistics:
    documents: int
    words: int
    weight: np.ndarray  # by term number

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 75 + 25 * n * self.documents // max(self.words, 1)
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _numbers(values, kind=np.int64) -> np.ndarray:
    return np.frombuffer(values, dtype=kind)


def forward_index(docs: DataFrame, vocabulary, id_col: str, text_col: str, block: int) -> DataFrame:
    """Blocks of documents with at least one term: ids, lengths, and the numbers and frequencies of known terms.

    ``vocabulary`` is a broadcast of term to number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, postings = TaskContext.get().partitionId(), 0, 0
        numbers = vocabulary.value.vocabulary
        ids, n, sizes, term, tf = [], [], [], [], []

        def packed() -> pa.RecordBatch:
            row = [f"{part}:{made}", len(ids), sum(n), list(ids), list(n), list(sizes), np.array(term, dtype=np.int32).tobytes(), np.array(tf, dtype=np.int32).tobytes()]
            types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, types)], names=["block", "docs", "words", "ids", "n", "sizes", "term", "tf"])
            for x in (ids, n, sizes, term, tf):
                x.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                words = terms(text.as_py())
                if not words:
                    continue
                known = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                ids.append(i)
                n.append(len(words))
                sizes.append(len(known))
                term += [t for t, _ in known]
                tf += [c for _, c in known]
                if len(ids) == block or len(term) >= POSTINGS:
                    yield packed()
                    made += 1
        if ids:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, _INDEX)


def statistics(index: DataFrame, size: int) -> Statistics:
    """Over all documents: their number and words, and the weight of each of ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for term in batch.column("term"):
                total += np.bincount(_numbers(term.as_buffer(), np.int32), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    row = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("l")).first()
    counts = index.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.full(size, math.floor(1000 * math.log(2 * row["n"] + 2)), dtype=np.int64)
    for r in counts.collect():  # a row a term of the queries
        weight[r["term"]] = math.floor(1000 * math.log((2 * row["n"] + 2) / (2 * r["df"] + 1)))
    return Statistics(row["n"], row["l"], weight)


def with_maxima(index: DataFrame, known: Statistics) -> DataFrame:
    """The blocks kept term by term: documents and impacts of each term, and the largest impact."""
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]
                term, tf = (_numbers(get(c).as_buffer(), np.int32).astype(np.int64) for c in ("term", "tf"))
                n, sizes = (get(c).values.to_numpy() for c in ("n", "sizes"))
                at = np.repeat(np.arange(len(n)), sizes)
                impact = known.impact(tf, n[at])
                order = np.lexsort((at, term))
                term, at, impact = term[order], at[order], impact[order]
                starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
                most = np.maximum.reduceat(impact, starts) if len(term) else impact
                row = [get("block").as_py(), get("ids").as_py(), len(term), term[starts].astype(np.int32).tobytes(), most.tobytes(), np.r_[starts, len(term)].astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), impact.astype(np.int32).tobytes()]
                types = [pa.string(), pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, types)], names=names)

    return index.mapInArrow(run, _BLOCKS)


def bounds(term: np.ndarray, most: np.ndarray, queries: Queries, weight: np.ndarray) -> np.ndarray:
    """For each query, what no document of a block with these maxima scores more than."""
    dense = np.zeros(len(weight) + 1, dtype=np.int64)
    dense[term] = most
    parts = np.r_[queries.times * weight[queries.term] * dense[queries.term], 0]
    total = np.add.reduceat(parts, np.minimum(queries.starts[:-1], len(parts) - 1))
    total[queries.starts[1:] == queries.starts[:-1]] = 0  # a query without terms
    return total


def seeds(blocks: DataFrame, queries, weight: np.ndarray, count: int) -> DataFrame:
    """(q, block): the ``count`` blocks with the highest bounds of each query, from the maxima alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = queries.value
        held: list[tuple[np.ndarray, list[str]]] = []
        if not len(asked):
            return

        def best() -> tuple[np.ndarray, np.ndarray]:
            bound = np.concatenate([b for b, _ in held])
            names = np.concatenate([np.asarray(x, dtype=object).reshape(-1, len(asked)) for _, x in held])
            order = np.argsort(-bound, axis=0, kind="stable")[:count]
            return np.take_along_axis(bound, order, axis=0), np.take_along_axis(names, order, axis=0)

        for batch in batches:
            for name, term, most in zip(batch.column("block").to_pylist(), batch.column("term"), batch.column("most")):
                bound = bounds(_numbers(term.as_buffer(), np.int32), _numbers(most.as_buffer()), asked, weight)
                held.append((bound[None, :], [name] * len(asked)))
                if len(held) > 64:
                    held = [best()]
        if held:
            bound, names = best()
            row, q = np.nonzero(bound > 0)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bound[row, q]), pa.array(names[row, q].tolist(), type=pa.string())], names=["q", "bound", "block"])

    found = blocks.select("block", "term", "most").mapInArrow(run, "q long, bound long, block string")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return found.withColumn("r", rank).where(F.col("r") <= count).select("q", "block")


@dataclass
class Block:
    ids: np.ndarray
    unnamed: np.ndarray
    term: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Block:
        ids = batch.column("ids")[i].values
        arrays = [_numbers(batch.column(c)[i].as_buffer(), np.int32) for c in ("term", "starts", "at", "impact")]
        return cls(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), *arrays)

    def scores(self, term: np.ndarray, coefficient: np.ndarray) -> np.ndarray:
        """The score of each document of the block for a query."""
        k = np.searchsorted(self.term, term)
        k[k == len(self.term)] = 0
        hit = self.term[k] == term if len(self.term) else np.zeros(len(term), dtype=bool)
        k, coefficient = k[hit], coefficient[hit]
        total = np.zeros(len(self.ids), dtype=np.int64)
        for a, b, c in zip(self.starts[k].tolist(), self.starts[k + 1].tolist(), coefficient.tolist()):
            total[self.at[a:b]] += c * self.impact[a:b].astype(np.int64)  # a document is there once a term
        return total


class Ranking:
    """The k best documents of each query so far: highest score, then smallest id, documents without an id last."""

    def __init__(self, queries: Queries, weight: np.ndarray, k: int, bar: np.ndarray):
        self.queries, self.k, self.bar = queries, k, bar.copy()
        self.coefficient = queries.times * weight[queries.term]
        self.found: dict[int, tuple[np.ndarray, ...]] = {}

    def meet(self, q: int, block: Block) -> None:
        own = slice(self.queries.starts[q], self.queries.starts[q + 1])
        scores = block.scores(self.queries.term[own], self.coefficient[own])
        ok = np.flatnonzero(scores >= self.bar[q])
        if not len(ok):
            return
        now = (scores[ok], block.unnamed[ok], block.ids[ok])
        if q in self.found:
            now = tuple(np.concatenate(x) for x in zip(self.found[q], now))
        order = np.lexsort((now[2], now[1], -now[0]))[: self.k]
        self.found[q] = tuple(x[order] for x in now)
        if len(order) == self.k:
            self.bar[q] = max(self.bar[q], self.found[q][0][-1])

    def result(self) -> pa.RecordBatch:
        rows = [(np.full(len(s), q), s, np.ma.array(i, mask=u)) for q, (s, u, i) in self.found.items()]
        q, s, i = ([x[c] for x in rows] for c in range(3))
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        ids = pa.array(joined([x.data for x in i]), mask=joined([np.ma.getmaskarray(x) for x in i]).astype(bool))
        return pa.RecordBatch.from_arrays([pa.array(joined(q)), pa.array(joined(s)), ids], names=["q", "score", "id"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(blocks: DataFrame, docs: DataFrame, asked: Queries, known: Statistics, k: int, band: int) -> DataFrame:
    spark = docs.sparkSession
    queries, weight = spark.sparkContext.broadcast(asked), known.weight
    first = np.ones(len(asked), dtype=np.int64)  # scores above 0 only
    chosen = seeds(blocks, queries, weight, SEEDS).groupBy("block").agg(F.collect_list("q").alias("qs"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Ranking(queries.value, weight, k, first)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.of(batch, i)
                for q in batch.column("qs")[i].as_py():
                    now.meet(q, block)
        yield now.result()

    # SEEDS blocks a query at most, by their names
    started = blocks.join(F.broadcast(chosen), "block").mapInArrow(begin, "q long, score long, id long")
    bar = first.copy()
    for r in ranked(started, k).where(F.col("rank") == k).select("q", "score").collect():  # a number a query
        bar[r["q"]] = max(bar[r["q"]], r["score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = queries.value
        now = Ranking(asked, weight, k, bar)
        held: list[Block] = []
        bound: list[np.ndarray] = []
        size = 0

        def through() -> None:
            matrix = np.stack(bound)
            order = np.argsort(-matrix, axis=0, kind="stable")
            for q in range(len(asked)):
                for b in order[:, q]:
                    if matrix[b, q] < now.bar[q]:
                        break
                    now.meet(q, held[b])
            held.clear()
            bound.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(Block.of(batch, i))
                bound.append(bounds(held[-1].term, _numbers(batch.column("most")[i].as_buffer()), asked, weight))
                size += batch.column("postings")[i].as_py()
                if len(held) == band or size >= BAND_POSTINGS:
                    through()
                    size = 0
        if held:
            through()
        yield now.result()

    return ranked(blocks.mapInArrow(search, "q long, score long, id long"), k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, band: int = BAND, query_chars: int = QUERY_CHARS) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents with the highest scores above 0 for each item.

    Equal scores go by ascending id; documents without an id are counted and ranked like any other and come last
    among equals. Repeated documents are as many documents. Equal items (in id and text) are one; an id with
    several texts has ranks for each. Null and empty texts have no term: such a document is not counted, such an
    item has no row. Whole texts of any length are read. An empty table on either side gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("text")).where("text is not null").distinct()
    chars = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-chars // query_chars))
    schema = asked.select("item").schema.add("q", "long")
    found = []
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()  # a bounded group
        queries = Queries.of([bytes(r["text"]) for r in some])
        vocabulary = spark.sparkContext.broadcast(queries)
        index = stored(forward_index(docs, vocabulary, id_col, text_col, block), "lexical-index")
        known = statistics(index, len(queries.vocabulary))
        blocks = stored(with_maxima(index, known), "lexical-blocks")
        names = spark.createDataFrame([(r["item"], q) for q, r in enumerate(some)], schema)
        found.append(_search(blocks, docs, queries, known, k, band).join(F.broadcast(names), "q").select("item", "rank", "id", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
