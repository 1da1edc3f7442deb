"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints of ``bits`` = 64 are cut into segments. Two fingerprints within ``radius`` bits differ by
at most ``r_i`` bits in some segment i, where the r_i are chosen so that sum(r_i + 1) > radius: for
radius 4 over three segments (21, 21 and 22 bits) these are 1, 1 and 0. So every fingerprint goes
into one table per segment, small Hamming balls of its segment values are looked up in the tables,
and complete distances are verified. No link within the radius can be missed.

Copies never meet each other: only distinct fingerprints are linked. A table entry with more than
``bucket_rows`` members is not compared pair by pair. Its fingerprints go to an exact second way: all
points within radius/2 of a fingerprint are enumerated, and fingerprints that share such a midpoint are
within the radius of each other, so a chain through each midpoint carries all their links in linear size.

``similar_groups`` and ``keep_one`` ask for similar shingle sets instead of near fingerprints. Scattered edits move more bits
than a ball can hold, so sets that meet in a table of minhashes (see ``minhash``) are candidates as well, and candidates are
compared on their whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, light
from tessera.llm.components import connected_components
from tessera.llm.families import linked, meeting
from tessera.llm.signatures import Collections, table_entries

SEED = 42
SHINGLE_BLOCK = 1 << 16


def shingle_bit_counts(text: str | None, width: int, seed: int = SEED) -> tuple[int, np.ndarray]:
    """Number of shingles and, per bit (most significant first), how many shingle hashes set it."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    counts = np.zeros(64, dtype=np.int64)
    if not words:
        return 0, counts
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < width:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stops = np.cumsum(sizes) + np.arange(len(words))
        starts, ends = (stops - sizes)[: len(words) - width + 1].tolist(), stops[width - 1 :].tolist()
    for k in range(0, len(starts), SHINGLE_BLOCK):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[k : k + SHINGLE_BLOCK], ends[k : k + SHINGLE_BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return len(starts), counts


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash; 0 for a text without words."""
    n, counts = shingle_bit_counts(text, width)
    value = int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


def fingerprint_column(text: Column, width: int = 4) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return run(text)


def segments(radius: int, parts: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) per segment; the radii sum to radius - parts + 1."""
    widths = [bits // parts + (i >= parts - bits % parts) for i in range(parts)]
    rest = max(0, radius - parts + 1)
    shifts = [sum(widths[i + 1 :]) for i in range(parts)]
    return [(shifts[i], widths[i], rest // parts + (i < rest % parts)) for i in range(parts)]


def index_rows(fps: DataFrame, radius: int, parts: int) -> DataFrame:
    """(seg, key, fp, probe): each fingerprint under its own segment values (probe false) and under the
    values of the balls around them. Of two fingerprints whose segment differs, only the one that has
    the highest differing bit set looks up the other."""
    def entries(i: int, shift: int, width: int, ball: int) -> list[Column]:
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

        def entry(key: Column, probe: bool) -> Column:
            return F.struct(F.lit(i).alias("seg"), key.cast("long").alias("key"), F.lit(probe).alias("probe"))

        masks = [sum(1 << j for j in c) for n in range(1, ball + 1) for c in combinations(range(width), n)]
        if not masks:
            return [F.array(entry(value, False))]
        flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(1 << (m.bit_length() - 1)).cast("long").alias("top")) for m in masks])
        hit = F.filter(flips, lambda f: value.bitwiseAND(f["top"]) != 0)
        return [F.array(entry(value, False)), F.transform(hit, lambda f: entry(value.bitwiseXOR(f["m"]), True))]

    arrays = [a for i, s in enumerate(segments(radius, parts)) for a in entries(i, *s)]
    return fps.select("fp", F.explode(F.concat(*arrays)).alias("r")).select("r.seg", "r.key", "fp", "r.probe")


def _span(fp: np.ndarray, radius: int, out: list[np.ndarray]) -> None:
    """Edges of a spanning forest of the links among ``fp``."""
    left = fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                out.append(np.stack([np.full(len(found), x), found]))
                queue.extend(found)
                left = left[~near]


def link_sorted(radius: int):
    """For rows sorted by (seg, key): the links within each (seg, key), as a spanning forest of each."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(seg: np.ndarray, key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[new, len(fp)])
        useful = (size > 1) & (np.add.reduceat(~probe, new) > 0)
        two = new[useful & (size == 2)]
        out = []
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        if near.any():
            out.append(np.stack([a[near], b[near]]))
        for s, n in zip(new[useful & (size > 2)].tolist(), size[useful & (size > 2)].tolist()):
            _span(fp[s : s + n], radius, out)
        if out:
            pairs = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("seg", "key", "fp", "probe")]
            cols[2] = cols[2].view(np.uint64)
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from linked(*[c[:last] for c in cols])
            carry = [c[last:] for c in cols]
        if carry is not None:
            yield from linked(*carry)

    return run


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links among ``fps`` through shared midpoints: exact, and linear in the number of fingerprints."""
    masks = np.array([sum(1 << j for j in c) for n in range(radius // 2 + 1) for c in combinations(range(64), n)], dtype=np.uint64)
    points, edges = pa.schema([("key", pa.int64()), ("fp", pa.int64())]), pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 64):
                part = fp[k : k + 64]
                keys = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part, len(masks)).view(np.int64))], schema=points)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0 = fp0 = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "fp"))
            if key0 is not None:
                key, fp = np.r_[key0, key], np.r_[fp0, fp]
            same = key[1:] == key[:-1]
            pairs = np.unique(np.stack([fp[:-1][same], fp[1:][same]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=edges)
            key0, fp0 = key[-1:], fp[-1:]

    spreaded = fps.mapInArrow(spread, "key long, fp long")
    return spreaded.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(chain, "a long, b long")


#: Up to this many fingerprints three segments leave few of them in a table entry; beyond, two wider ones do.
THREE_SEGMENTS = 1 << 27


def fingerprint_links(fps: DataFrame, radius: int = 4, parts: int | None = None, bucket_rows: int = 4096) -> DataFrame:
    """(a, b) links between distinct fingerprints of column ``fp``: a forest per table entry that
    connects exactly what the links within ``radius`` connect, with any number of segments (``parts``)."""
    if radius % 2:
        raise ValueError("radius must be even")
    distinct = fps.select("fp").where("fp is not null").distinct()
    rows = index_rows(distinct, radius, parts or (3 if distinct.count() <= THREE_SEGMENTS else 2))
    crowded = rows.groupBy("seg", "key").count().where(F.col("count") > bucket_rows).select("seg", "key")
    crowded = cut(crowded)
    ordinary = rows.join(crowded, ["seg", "key"], "left_anti")
    links = ordinary.repartition("seg", "key").sortWithinPartitions("seg", "key").mapInArrow(link_sorted(radius), "a long, b long")
    if crowded.isEmpty():
        return links
    hot = rows.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
    return links.unionByName(ball_links(hot, radius))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(id, fp, root, component): one row per document.

    ``fp`` is the signed 64-bit SimHash over ``width``-word shingles of the whole text, ``root`` the smallest
    fingerprint and ``component`` the smallest id reachable over links of ``radius`` or fewer differing bits. Null and empty texts have
    fingerprint 0 and link like any other. Rows with a null id take part and have the component of their
    fingerprint, null only if no row of the group has an id. Repeated rows stay repeated. An empty table
    gives an empty result. Other columns are ignored.
    """
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = cut(connected_components(fingerprint_links(distinct, radius, bucket_rows=bucket_rows)))
    # most fingerprints have no link; those that have may be few enough to travel
    linked = cut(roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least"))
    named = light(linked.groupBy("root").agg(F.min("least").alias("component")))
    of = light(linked.join(named, "root").select("fp", "root", "component"))
    alone = distinct.join(of.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component"))
    every = of.unionByName(alone)
    return prints.join(every, "fp").select("id", "fp", "root", "component")


#: Rows with text keys up to which a counted side is broadcast: some ten MB, which the driver has to hold as well.
LIGHT_KEYS = 100_000
#: Short keys of either collection, and minhashes of a short key: two sets of similarity 0.8 meet in none of the tables
#: with a probability of 1.5e-4, of 0.85 with 5e-6.
SIDE, WIDTH = 18, 4


def text_key(text: Column) -> Column:
    """128 bits of a text, null being empty: texts with one key are taken as equal."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; of fewer words, of all of them together."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)).view(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, k, s, fp, keys): what a text is compared by, the text left out: the keys of the text and of its shingle set, the
    fingerprint and the set's short keys."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    hashes = Collections(SIDE, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [_shingle_hashes(_words(t), width) for t in texts]
            made = [hashes.keys(h.view(np.uint64))[0] if len(h) else [] for h in sets]
            columns = [pa.array([hashlib.md5(h.tobytes()).digest() for h in sets], type=pa.binary()), pa.array([fingerprint(t, width) for t in texts], type=pa.int64()), pa.array(made, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), *columns], names=["id", "k", "s", "fp", "keys"])

    return rows.mapInArrow(run, f"id {kind}, k binary, s binary, fp long, keys array<long>")


def shared_keys(sets: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """(key, t) under which sets meet: each fingerprint, each link of the fingerprints by multi-index hashing, and the tables
    of minhashes."""
    tables = table_entries(sets, SIDE).select("key", "t")
    prints = cut(sets.groupBy("fp").agg(F.min("t").alias("t")))
    same = sets.join(prints.select("fp", F.col("t").alias("rep")), "fp").where("t != rep").select(F.col("t").alias("a"), F.col("rep").alias("b"))
    one = lambda c: prints.select(F.col("fp").alias(f"fp_{c}"), F.col("t").alias(c))
    near = fingerprint_links(prints, radius, bucket_rows=bucket_rows).toDF("fp_a", "fp_b").join(one("a"), "fp_a").join(one("b"), "fp_b").select("a", "b")
    pairs = same.unionByName(near).distinct().select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("t"))
    return tables.unionByName(pairs)


def full_sets(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(t, h): the shingle sets of ``asked`` (t, k, owner), each from one text that has the key ``k`` and the id ``owner``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [_shingle_hashes(_words(t), width) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(found, type=pa.list_(pa.int64()))], names=["t", "h"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    # a copy with another id is not read again; rows that repeat the owner are equal
    chosen = rows.join(light(asked, LIGHT_KEYS), "k").where(F.col("id").eqNullSafe(F.col("owner"))).select("t", "text")
    return chosen.mapInArrow(run, "t long, h array<long>").dropDuplicates(["t"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(id, k, root, component): one row per document; ``component`` is the smallest id among the texts reachable over pairs
    of at least ``similarity`` in their ``width``-word shingles, ``root`` names the group and ``k`` the text.

    Sets whose fingerprints multi-index hashing links, and sets that meet in a table of minhashes, are a family, whose whole sets
    ``families.linked`` compares. A pair can be lost only if it meets nowhere (``SIDE``). Words are those of ``simhash_groups``; texts without words are one
    group, and so are texts of fewer than ``width`` words that are equal. Null texts are empty. Rows with a null id take
    part. Repeated rows stay repeated. An empty table gives an empty result. Other columns are ignored.
    """
    rows = cut(sketches(docs, id_col, text_col, width))
    one = rows.groupBy("s").agg(F.min(F.struct("id", "k")).alias("least"), F.min("id").alias("owner"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    # ids of the sets are their places in the table as it is written here
    sets = cut(one.withColumn("t", F.monotonically_increasing_id()))
    of = cut(meeting(cut(shared_keys(sets, radius, bucket_rows))))
    asked = sets.join(of, "t").select("t", F.col("least.k").alias("k"), F.col("least.id").alias("owner"))
    least = Fraction(str(similarity))
    roots = linked(of, full_sets(docs, asked, id_col, text_col, width), least.numerator, least.denominator)
    joined = roots.select(F.col("node").alias("t"), "root").join(sets.select("t", "s", "owner"), "t")
    named = light(joined.groupBy("root").agg(F.min("owner").alias("least")), LIGHT_KEYS)
    of = light(joined.join(named, "root").select("s", "root", "least"), LIGHT_KEYS)
    every = sets.select("s", "t", "owner").join(of, "s", "left")
    grouped = F.col("root").isNotNull()
    each = every.select("s", F.coalesce("root", "t").alias("root"), F.when(grouped, F.col("least")).otherwise(F.col("owner")).alias("component"))
    return rows.select("id", "k", "s").join(each, "s").select("id", "k", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each group of ``similar_groups``: the smallest id.

    Of rows that share this id, one whose text has the smallest key stays. A group without any id keeps one of
    its rows with the smallest key. Rows that are equal in id and text count as one, whatever is in their other columns.
    """
    groups = cut(similar_groups(docs, id_col, text_col, **options))
    mine = F.col("id").eqNullSafe(F.col("component"))
    gone_id, key, kept_id = fresh(docs, "_gone"), fresh(docs, "_key"), fresh(docs, "_kept")
    if groups.where("id is null").isEmpty() and groups.groupBy("id").count().where("count > 1").isEmpty():
        # there are fewer rows to drop than to keep, and the texts stay where they are while those are few
        gone = light(groups.where(~mine).select(F.col("id").alias(gone_id)))
        return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    keep = groups.where(mine).groupBy("root").agg(F.min("id").alias(kept_id), F.min("k").alias(f"{key}_kept")).drop("root")
    marked = docs.withColumn(key, text_key(F.col(text_col)))
    kept = marked.join(keep, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(f"{key}_kept")), "left_semi")
    return kept.dropDuplicates([id_col, key]).drop(key)
