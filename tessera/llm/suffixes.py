"""Repeated passages by sparse suffix arrays.

A text is a row of words; its ``GRAM``-word grams are hashed, and of every ``MIN_WORDS`` words in a row the
position with the smallest gram hash (the first of equals) is kept. The choice depends on those words only, so
two texts that share a passage of ``MIN_WORDS`` words keep the same position in it. Only suffixes at kept positions
whose gram occurs again are retained, with as many words to the left and right as a passage can reach.

The suffixes are sorted over the cluster by range (rows are all different, so ranges are even) and each is compared
with its neighbours; equal words to the right and, from the same position, to the left give the match. Two
suffixes of one gram are neighbours, so their match is complete. Where three or more meet, a neighbour with other
words to the left can hide a match; there the ``MIN_WORDS`` words of each place are compared by hash as well, so that
every repeated passage is found. Equal texts are examined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, light

MIN_WORDS = 50
GRAM = 8
#: A passage with more places than this is not dealt out by its hash.
CROWDED = 1000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def word_hashes(text: str) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.fromiter((digest(w) for w in text.split()), dtype=np.uint32)


def kept_positions(words: np.ndarray, least: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept positions, their gram hashes, and the first and last start of the passages that chose each."""
    n = len(words)
    if n < least:
        return (np.zeros(0, dtype=np.int64),) * 4
    h = np.zeros(n - gram + 1, dtype=np.uint64)
    for j in range(gram):
        h = (h ^ words[j : n - gram + 1 + j]) * _PRIME
        h ^= h >> _SHIFT
    width = least - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    chosen = np.concatenate([views[k : k + 65536].argmin(axis=1) + np.arange(k, min(k + 65536, len(views))) for k in range(0, len(views), 65536)])
    new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[new[1:], len(chosen)] - 1
    return chosen[new], h[chosen[new]].view(np.int64), new, last


def survey(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int) -> DataFrame:
    """(id, h, chars, words, positions, grams): one row per document, text left out."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.length(text_col).alias("chars"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, positions, grams = [], [], []
            for t in batch.column("text").to_pylist():
                w = word_hashes(t or "")
                p, g, _, _ = kept_positions(w, least, gram)
                words.append(len(w))
                positions.append(p.astype(np.int32))
                grams.append(g)
            offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in positions])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], type=t)) for x, t in ((positions, pa.int32()), (grams, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), batch.column("chars"), pa.array(words, type=pa.int32()), *lists], names=["id", "h", "chars", "words", "positions", "grams"])

    return rows.mapInArrow(run, "id long, h long, chars int, words int, positions array<int>, grams array<long>")


_SUFFIX = "gram long, ahead binary, behind binary, h long, pos int, left int, right int, owner long, many boolean, first int, last int"


def retained(docs: DataFrame, id_col: str, wanted: DataFrame, text_col: str, least: int, gram: int) -> DataFrame:
    """A row per retained suffix with the words ahead and, backwards, behind."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.length(text_col).alias("chars"), F.col(text_col).alias("text"))
    # of equal texts the owner's is read
    rows = rows.join(wanted, ["h", "chars"]).where(F.col("id").eqNullSafe(F.col("owner")))
    back = least - gram
    schema = pa.schema([("gram", pa.int64()), ("ahead", pa.binary()), ("behind", pa.binary()), ("h", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("owner", pa.int64()), ("many", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, h, owner = (batch.column(c)[i].as_py() for c in ("text", "h", "owner"))
                words = word_hashes(text)
                p, g, first, last = kept_positions(words, least, gram)
                ask = batch.column("wanted")[i].values
                at = np.searchsorted(p, np.sort(ask.field("pos").to_numpy(zero_copy_only=False)))
                order = np.argsort(ask.field("pos").to_numpy(zero_copy_only=False))
                many = ask.field("many").to_numpy(zero_copy_only=False)[order]
                padded = np.r_[np.zeros(back, dtype=np.uint32), words, np.zeros(least, dtype=np.uint32)]
                for k in range(0, len(at), 2048):
                    a = at[k : k + 2048]
                    ahead = padded[(p[a] + back)[:, None] + np.arange(least)].astype(">u4")
                    behind = padded[(p[a] + back - 1)[:, None] - np.arange(back)].astype(">u4")
                    left, right = np.minimum(p[a], back), np.minimum(len(words) - p[a], least)
                    blobs = [pa.array([x.tobytes() for x in m], type=pa.binary()) for m in (ahead, behind)]
                    n = len(a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[a]), *blobs, pa.array([h] * n), pa.array(p[a].astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array([owner] * n, type=pa.int64()), pa.array(many[k : k + 2048]), pa.array(first[a].astype(np.int32)), pa.array(last[a].astype(np.int32))],
                        schema=schema,
                    )

    return rows.mapInArrow(run, _SUFFIX)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row: how many entries agree from the start."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class _Rows:
    """Columns of consecutive suffixes."""

    def __init__(self, batch: pa.RecordBatch, least: int, gram: int):
        col = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
        blob = lambda n, w: np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=">u4").reshape(-1, w)
        self.gram, self.h, self.pos, self.left, self.right = (col(n) for n in ("gram", "h", "pos", "left", "right"))
        self.owner = batch.column("owner").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.ahead, self.behind = blob("ahead", least), blob("behind", least - gram)

    def matches(self, least: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(h, start, end, later) for both sides of each pair of neighbours that match over ``least`` words."""
        if len(self.h) < 2:
            return
        cols = (self.right, self.left, self.h, self.pos, self.owner)
        (ra, la, ha, pa_, oa), (rb, lb, hb, pb, ob) = [c[:-1] for c in cols], [c[1:] for c in cols]
        pair = np.flatnonzero((self.gram[1:] == self.gram[:-1]) & ~((ha == hb) & (pa_ == pb)))
        r = np.minimum(_same(self.ahead[pair], self.ahead[pair + 1]), np.minimum(ra, rb)[pair])
        le = np.minimum(_same(self.behind[pair], self.behind[pair + 1]), np.minimum(la, lb)[pair])
        ok = r + le >= least
        pair, r, le = pair[ok], r[ok], le[ok]
        a_first = np.array([(x, y, z) < (u, v, w) for x, y, z, u, v, w in zip(oa[pair].tolist(), ha[pair].tolist(), pa_[pair].tolist(), ob[pair].tolist(), hb[pair].tolist(), pb[pair].tolist())], dtype=bool)
        yield ha[pair], pa_[pair] - le, pa_[pair] + r, ~a_first
        yield hb[pair], pb[pair] - le, pb[pair] + r, a_first


_SPAN = pa.schema([("h", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("later", pa.bool_()), ("part", pa.int32()), ("edge", pa.binary())])


def _span_batch(h, start, end, later) -> pa.RecordBatch:
    n = len(h)
    return pa.RecordBatch.from_arrays([pa.array(h, type=pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(later), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_SPAN)


def neighbour_matches(suffixes: DataFrame, least: int, gram: int) -> DataFrame:
    """(h, start, end, later): matches between neighbours in the sorted order, over the edges of partitions too."""
    key = ["gram", "ahead", "behind", "h", "pos"]
    keep = [f.name for f in suffixes.schema if f.name not in ("many", "first", "last")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        head = tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.Table.from_batches([tail, batch] if tail is not None else [batch]).combine_chunks().to_batches()[0]
            for spans in _Rows(joined, least, gram).matches(least):
                if len(spans[0]):
                    yield _span_batch(*spans)
            head = head if head is not None else batch.slice(0, 1)
            tail = pa.Table.from_batches([batch.slice(batch.num_rows - 1)]).combine_chunks().to_batches()[0]
        if head is not None:
            blobs = []
            for edge in (head, tail):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, edge.schema) as w:
                    w.write_batch(edge)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.nulls(2, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.bool_())] + [pa.array([2 * part, 2 * part + 1], type=pa.int32()), pa.array(blobs, type=pa.binary())], schema=_SPAN)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pa.ipc.open_stream(x).read_all() for b in batches for x in b.column("edge").to_pylist()]
        if rows:
            joined = pa.concat_tables(rows).combine_chunks().to_batches()[0]
            for spans in _Rows(joined, least, gram).matches(least):
                yield _span_batch(*spans)

    out = "h long, start int, end int, later boolean, part int, edge binary"
    found = cut(suffixes.select(*keep).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(scan, out))
    # two rows for each partition meet in one task
    edges = found.where("edge is not null").select("part", "edge").coalesce(1).sortWithinPartitions("part").mapInArrow(across, out)
    return found.where("edge is null").unionByName(edges).select("h", "start", "end", "later")


def passage_matches(suffixes: DataFrame, least: int, gram: int) -> DataFrame:
    """(h, start, end, later): the passages of exactly ``least`` words around suffixes of crowded grams that occur again."""
    back = least - gram
    schema = pa.schema([("w", pa.int64()), ("owner", pa.int64()), ("h", pa.int64()), ("start", pa.int32())])
    powers = np.array([pow(int(_PRIME), least - j, 1 << 64) for j in range(least)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                rows = _Rows(part, least, gram)
                words = np.concatenate([rows.behind[:, ::-1], rows.ahead], axis=1).astype(np.uint64)
                words = (words ^ (words >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)
                first, last = (part.column(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                for o in range(back + 1):
                    start = rows.pos - back + o
                    mine = np.flatnonzero((start >= first) & (start <= last))
                    if len(mine):
                        w = (words[mine, o : o + least] * powers).sum(axis=1, dtype=np.uint64)
                        w ^= w >> np.uint64(31)
                        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(rows.owner[mine]), pa.array(rows.h[mine]), pa.array(start[mine].astype(np.int32))], schema=schema)

    places = suffixes.where("many").mapInArrow(run, "w long, owner long, h long, start int").select("w", F.struct("owner", "h", "start").alias("place"))
    places = cut(places)
    again = cut(places.groupBy("w").agg(F.min("place").alias("least"), F.max("place").alias("most"), F.count(F.lit(1)).alias("n")).where("least != most").select("w", "least", "n"))
    # a passage that many texts share is looked up where its places are; there can be few of them, since each has many places
    crowded = light(again.where(F.col("n") > CROWDED))
    rare = again.where(F.col("n") <= CROWDED)
    hits = places.join(crowded, "w").unionByName(places.join(crowded.select("w"), "w", "left_anti").join(light(rare), "w"))
    return hits.select("place.h", "place.start", (F.col("place.start") + least).alias("end"), (F.col("place") != F.col("least")).alias("later"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(id, same_as, words, repeated, later): one row per document.

    ``repeated`` are the stretches of words (start, end exclusive, merged) covered by passages of ``least`` or more
    words that occur somewhere else too, ``later`` those of them of which another occurrence comes first, by id and
    position. ``same_as`` is the smallest id with the same text; a text that others equal is repeated whole if it
    has ``least`` words. Null and empty texts have no words; null ids come last. Repeated rows stay repeated and
    equal each other. Other columns are ignored.
    """
    rows = cut(survey(docs, id_col, text_col, least, gram))
    texts = cut(rows.where("words >= %d" % least).groupBy("h", "chars").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("copies"), F.first("positions").alias("positions"), F.first("grams").alias("grams")))
    places = texts.select("h", "chars", "owner", F.inline(F.arrays_zip("positions", "grams")))
    crowd = places.groupBy("grams").count().where("count > 1").select("grams", (F.col("count") > 2).alias("many"))
    wanted = places.join(crowd, "grams").groupBy("h", "chars", "owner").agg(F.collect_list(F.struct(F.col("positions").alias("pos"), "many")).alias("wanted"))
    suffixes = cut(retained(docs, id_col, wanted, text_col, least, gram))
    found = neighbour_matches(suffixes, least, gram).unionByName(passage_matches(suffixes, least, gram))
    grouped = found.distinct().groupBy("h").agg(F.collect_list(F.struct("start", "end", "later")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            every, later = [], []
            for spans in batch.column("spans").to_pylist():
                every.append([{"start": s, "end": e} for s, e in _merged([(x["start"], x["end"]) for x in spans])])
                later.append([{"start": s, "end": e} for s, e in _merged([(x["start"], x["end"]) for x in spans if x["later"]])])
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(every, type=kind), pa.array(later, type=kind)], names=["h", "every", "later_spans"])

    stretch = "array<struct<start:int,end:int>>"
    merged = grouped.mapInArrow(merge, f"h long, every {stretch}, later_spans {stretch}")
    none = F.array().cast(stretch)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("words").alias("end"))).cast(stretch)
    joined = rows.drop("positions", "grams").join(texts.select("h", "chars", "owner", "copies"), ["h", "chars"], "left").join(merged, "h", "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    return joined.select(
        "id",
        F.coalesce("owner", "id").alias("same_as"),
        "words",
        F.when(copied, whole).otherwise(F.coalesce("every", none)).alias("repeated"),
        F.when(copied & ~F.col("id").eqNullSafe(F.col("owner")), whole).otherwise(F.coalesce("later_spans", none)).alias("later"),
    )
