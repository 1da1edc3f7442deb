"""Byte-level BPE by overlapping chunks, and back.

A pre-token depends on the text from its start on, and on few characters behind its end, so two tokenisations
that share one boundary agree from there on. A text of more than ``CHUNK`` code points becomes rows of
overlapping chunks, dealt over the tasks and pre-tokenised on their own. Neighbours are stitched at the first boundary that
both have in their overlap: the task of a chunk has the overlap behind it, so it finds that seam itself, encodes the piece
up to it, and notes how many ids stand before each boundary in the overlap before it. The ids of a text then meet, and the
seam of each chunk says what to leave out of the next one. An overlap reaches over the first single space between two
visible characters behind it, where every tokenisation has a boundary; a run that is longer than a chunk just makes the
chunk longer. A text of one chunk needs no stitching.

Decoding concatenates the bytes of the tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 13
OVERLAP = 1 << 8
#: What a pre-token may look at behind its end: boundaries this near to the end of a chunk are not sure.
MARGIN = 8
_MEETING = re.compile(r"\S \S")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with one vocabulary. ``path``: ranks, one base64 token and its rank per line."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._token[rank] = token

    def boundaries(self, text: str) -> np.ndarray:
        """Starts of the pre-tokens of ``text`` by itself that stand behind a visible character.

        How a run of white space is split depends on what follows it, so a piece must not end with one."""
        return np.fromiter((a for m in self.pattern.finditer(text) if (a := m.start()) and not text[a - 1].isspace()), dtype=np.int32)

    def encode(self, piece: str | None) -> np.ndarray:
        """Ids of a text, or of a piece of one between two boundaries, without special tokens."""
        return np.array(self._encode(piece) if piece else [], dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        token = self._token
        return b"".join([token[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path, pattern)


def _parts(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of a text column, so that long texts do not pile up in one result."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))


def _encoded(path: str, pattern: str, keys: list[str], raw: bool):
    """Texts to ``keys`` and ids, with the decoded bytes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in _parts(batch, "text"):
                found = [c.encode(t) for t in part.column("text").to_pylist()]
                columns = [part.column(k) for k in keys] + [_id_lists(found)]
                if raw:
                    columns.append(pa.array([c.decode(x.tolist()) for x in found], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "ids", "raw"][: len(columns)])

    return run


def chunk_spans(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, begin of the next): chunks of about ``chunk`` code points with their overlaps; -1 behind the last."""
    begin, n = 0, len(text)
    while True:
        least = begin + chunk
        meeting = _MEETING.search(text, least + overlap - 1) if least < n else None
        end = meeting.end() + 2 * MARGIN if meeting else n
        if meeting is None or end >= n:
            yield begin, n, -1
            return
        then = max(least, meeting.start() - overlap)
        yield begin, end, then
        begin = then


def chunk_rows(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, id, k, text, head, next): the chunks of each text; ``head`` is how far the one before reaches into a chunk,
    ``next`` where the one behind it begins, -1 if there is none."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, text = batch.slice(i, 1), batch.column("text")[i].as_py()
                head = 0
                for k, (begin, end, then) in enumerate(chunk_spans(text, chunk, overlap)):
                    own = [pa.array([x], type=pa.int32()) for x in (head, then - begin if then >= 0 else -1)]
                    yield pa.RecordBatch.from_arrays([row.column("row"), row.column("id"), pa.array([k], type=pa.int32()), pa.array([text[begin:end]]), *own], names=["row", "id", "k", "text", "head", "next"])
                    head = end - then

    return texts.mapInArrow(run, f"row long, id {kind}, k int, text string, head int, next int")


def seam(left: np.ndarray, text: str, at: int, c: Codec) -> int:
    """The first boundary behind ``at`` that ``left``, the boundaries of a chunk, shares with the chunk that begins there."""
    right = c.boundaries(text[at:]) + at
    sure = left[(left > at) & (left < len(text) - MARGIN)]
    meet = np.intersect1d(sure, right)
    if not len(meet):
        raise ValueError("two chunks share no boundary: this pattern needs another place for them to meet")
    return int(meet[0])


def _pieces(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        lists = pa.list_(pa.int32())
        for batch in batches:
            for part in _parts(batch, "text"):
                found, seams, bounds, counts = [], [], [], []
                for text, head, then in zip(*(part.column(x).to_pylist() for x in ("text", "head", "next"))):
                    at = c.boundaries(text)
                    stop = seam(at, text, then, c) if then >= 0 else len(text)
                    first = at[(at < head) & (at < stop)]
                    cuts = [0, *first.tolist(), stop]
                    ids = [c.encode(text[a:b]) for a, b in zip(cuts, cuts[1:])]
                    found.append(np.concatenate(ids))
                    seams.append(stop - then if then >= 0 else -1)
                    bounds.append(first)
                    counts.append(np.cumsum([len(x) for x in ids[:-1]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), part.column("k"), pa.array(seams, type=pa.int32()), pa.array(bounds, type=lists), pa.array(counts, type=lists), _id_lists(found)],
                    names=["row", "id", "k", "seam", "bounds", "counts", "ids"],
                )

    return run


def stitched(texts: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids) of (row, id, text) rows, ``row`` being unique, by chunks in parallel."""
    kind = texts.schema["id"].dataType.simpleString()
    dealt = chunk_rows(texts, chunk, overlap).repartition("row", "k")
    done = dealt.mapInArrow(_pieces(path, pattern), f"row long, id {kind}, k int, seam int, bounds array<int>, counts array<int>, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("k", "seam", "bounds", "counts", "ids")))
    met = done.groupBy("row").agg(F.first("id").alias("id"), parts.alias("parts"))

    def kept(x, i):
        before = F.get("parts", i - 1)["seam"]
        skipped = F.get(x["counts"], (F.array_position(x["bounds"], before) - 1).cast("int"))
        return F.when(i == 0, x["ids"]).otherwise(F.slice(x["ids"], skipped + 1, F.size(x["ids"])))

    return met.select("id", F.flatten(F.transform("parts", kept)).alias("ids"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", raw: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids): the token ids of each whole text; with ``raw`` also the bytes that they decode to.

    A null text counts as empty, an empty one has no ids. Rows stay apart (repeated rows give repeated results, rows
    with a null id stay); an empty table gives an empty result; other columns are ignored, whatever their names.
    ``path`` must be readable on every executor.
    """
    if not 2 * MARGIN < overlap < chunk:
        raise ValueError("an overlap must be longer than its margins and shorter than a chunk")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    schema = f"id {kind}, ids array<int>" + (", raw binary" if raw else "")
    short = rows.where(~long).mapInArrow(_encoded(path, pattern, ["id"], raw), schema)
    texts = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    joined = stitched(texts, path, pattern, chunk, overlap)
    return short.unionByName(decode(joined, path, pattern) if raw else joined)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, raw): the bytes of the tokens put together. A null list gives empty bytes."""
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raws = [c.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(raws, type=pa.binary())], names=["id", "ids", "raw"])

    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, raw binary")
