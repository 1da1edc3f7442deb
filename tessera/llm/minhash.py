"""MinHash near-duplicate groups by tensored banding.

A table key needs ``2 * width`` minhashes to tell texts apart, and ``tables`` tables each with new ones would cost
their product. Here two collections of ``side`` short keys, each of ``width`` minhashes, are made, and a table takes
one key of either: ``side`` squared tables from ``2 * side * width`` minhashes. Two sets of similarity s meet in no
table only if all keys of a collection differ, (1 - s**width)**side for either: 1.5e-4 together at 0.85, 2.4e-5 at 0.87.
Keys of which no second set has the same are left out before they are combined.

Texts with one shingle set are one entry. Sets that share a table key are a family, of whose full shingle sets
``families.linked`` gives the groups that all pairs would, without making them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, light
from tessera.llm.families import linked, meeting
from tessera.llm.signatures import Collections, table_entries
from tessera.llm.simhash import LIGHT_KEYS, text_key

SEED = 42
SIDE = 20
WIDTH = 6


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8; of fewer words, of all of them together.

    Words are what white space of ASCII divides, with ASCII letters lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(sizes) + np.arange(len(words))
    n = max(1, len(words) - width + 1)
    starts, ends = (stops - sizes)[:n].tolist(), stops[len(words) - n :].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends)]), dtype=">u8").astype(np.uint64))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, collections: Collections) -> DataFrame:
    """(id, k, s, n, keys): the keys of the text and of its shingle set (null without words), its size and short keys."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column("text")]
            sets = pa.array([hashlib.md5(h.tobytes()).digest() if len(h) else None for h in found], type=pa.binary())
            keys = pa.array([collections.keys(h)[0] if len(h) else None for h in found], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), sets, pa.array([len(h) for h in found], type=pa.int64()), keys], names=["id", "k", "s", "n", "keys"])

    return rows.mapInArrow(run, f"id {kind}, k binary, s binary, n long, keys array<long>")


def full_sets(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(t, h): the shingle sets of ``asked`` (t, k, owner), each from one text that has the key ``k`` and the id ``owner``."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [shingles(t.as_py(), width).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(found, type=pa.list_(pa.int64()))], names=["t", "h"])

    # a copy with another id is not read again; rows that repeat the owner are equal
    chosen = rows.join(light(asked, LIGHT_KEYS), "k").where(F.col("id").eqNullSafe(F.col("owner"))).select("t", "text")
    return chosen.mapInArrow(run, "t long, h array<long>").dropDuplicates(["t"])


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, side: int = SIDE, minhashes: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, n, component): one row per document; ``n`` is the size of its shingle set, ``component`` the smallest id
    reachable over pairs whose intersection is at least ``percent`` hundredths of their union.

    Texts of fewer than ``width`` words are one shingle. Null texts and texts without words have an empty set and are
    linked with nothing, not even each other. Rows with a null id take part; their component is null only where no row
    of the group has an id. Repeated rows stay repeated. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    rows = cut(sketches(docs, id_col, text_col, width, Collections(side, minhashes, seed)))
    one = rows.where("s is not null").groupBy("s").agg(F.min(F.struct("id", "k")).alias("least"), F.min("id").alias("owner"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    # ids of the sets are their places in the table as it is written here
    texts = cut(one.withColumn("t", F.monotonically_increasing_id()))
    of = cut(meeting(cut(table_entries(texts, side).select("key", "t"))))
    read = texts.join(of, "t").select("t", F.col("least.k").alias("k"), F.col("least.id").alias("owner"))
    roots = linked(of, full_sets(docs, read, id_col, text_col, width), percent, 100)
    joined = roots.select(F.col("node").alias("t"), "root").join(texts.select("t", "s", "owner"), "t")
    named = light(joined.groupBy("root").agg(F.min("owner").alias("component")), LIGHT_KEYS)
    of = light(joined.join(named, "root").select("s", F.lit(True).alias("joined"), "component"), LIGHT_KEYS)
    every = texts.select("s", "owner").join(of, "s", "left").select("s", F.when(F.col("joined"), F.col("component")).otherwise(F.col("owner")).alias("component"))
    alone = rows.where("s is null").select("id", "n", F.col("id").alias("component"))
    return rows.where("s is not null").join(every, "s").select("id", "n", "component").unionByName(alone)
