"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

1. Words are runs of letters and digits in lower case; a shingle is ``WIDTH`` of them.
2. A window is as long as an item. A match needs a certain number of shingles in common (from the bound on the
   similarity and the two sizes), so windows are laid at every start from which that many shingles of the item occur
   within its length, whatever their order. Where neither the item nor its shingles in the text repeat one, the number in
   common is the similarity, and of these starts only the first with the most is kept.
3. Each window and each item gets a SimHash over its shingles, repeats included. Fingerprints are cut into
   ``BLOCKS`` blocks; every fingerprint within ``RADIUS`` bits agrees with the item in one block up to that
   block's share of the radius (see ``simhash.segments``), and these small balls are enumerated for the items.
   So the lookup by (item, block, value) finds all windows within the radius, among those laid for the item.
4. The candidates are verified: a window matches if its shingles and the item's, weighted by how often each
   occurs, have a Jaccard similarity (sum of minima over sum of maxima) of at least ``SIMILARITY``.

Equal texts are examined once, and equal items count as the one with the smallest id.
Null and empty texts contain nothing, null and word-less items match nothing. An item of fewer than
``WIDTH`` words is one shingle of all its words. Repeated rows are reported each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LIGHT_ROWS, cut, fresh, light
from tessera.llm.simhash import segments

WIDTH = 5
SIMILARITY = 0.8
#: Windows of at least ``SIMILARITY`` are nearly all within this many bits of their item, see the tests and the README.
RADIUS = 24
BLOCKS = 8
KEY = ("text_hash", "text_size")
_LANES = 32
_ONES = (1 << 32) | 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(KEY[0]), F.length(text).alias(KEY[1])]


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, width: int) -> Column:
    """Hash of every ``width`` words in a row."""

    def of(ws: Column) -> Column:
        n = F.size(ws) - width
        at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))

    return _let(words, of)


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, size, off, h): the shingles of the distinct items, in order."""
    rows = items.select(F.col(id_col).alias("item"), word_hashes(F.col(text_col)).alias("w")).where("w is not null and size(w) > 0 and item is not null")
    rows = rows.groupBy("w").agg(F.min("item").alias("item")).withColumn("size", F.size("w"))
    whole = F.when(F.col("size") >= WIDTH, shingles(F.col("w"), WIDTH))
    for k in range(1, WIDTH):
        whole = whole.when(F.col("size") == k, shingles(F.col("w"), k))
    return rows.select("item", "size", F.posexplode(whole).alias("off", "h"))


def simhash_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n, fp: majority bits of column ``h`` per group. Two counters share a 64-bit sum."""
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_ONES))).alias(f"s{j}") for j in range(_LANES)]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *lanes)
    low = [F.when(F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(_LANES)]
    high = [F.when(F.shiftrightunsigned(f"s{j}", 32) * 2 > F.col("n"), F.lit((1 << (j + 32)) - (1 << 64) * (j == 31))).otherwise(F.lit(0)) for j in range(_LANES)]
    fp = F.lit(0).cast("long")
    for bit in [*low, *high]:
        fp = fp.bitwiseOR(bit.cast("long"))
    return sums.select(*by, "n", fp.alias("fp"))


def _block_values(radius: int, blocks: int, balls: bool) -> Column:
    """array<struct<block,value>> of ``fp``: its own block values, or all values in the balls around them."""
    out = []
    for i, (shift, width, ball) in enumerate(segments(radius, blocks)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = [sum(1 << j for j in c) for n in range(ball + 1 if balls else 1) for c in combinations(range(width), n)]
        out += [F.struct(F.lit(i).alias("block"), value.bitwiseXOR(F.lit(m)).cast("long").alias("value")) for m in masks]
    return F.array(*out)


def starts(similarity: float) -> Column:
    """array<int>: where windows of ``m`` shingles begin that can match the item, from ``hits``, the sorted (pos, h) of its
    shingles in the text, of which there are ``total``, and from its number ``n`` of shingles, ``kinds`` of them different."""
    need = F.greatest(F.lit(1), F.ceil((F.col("m") + F.col("n")) * (similarity / (1 + similarity)) - 1e-9).cast("int"))

    def reach(c: Column) -> Column:
        some = F.sequence(F.lit(0), F.size("hits") - c)

        def of(i: Column) -> Column:
            first, last = F.get("hits", i)["pos"], F.get("hits", i + c - 1)["pos"]
            low, high = F.greatest(F.lit(0), last - F.col("m") + 1), F.least(first, F.col("total") - F.col("m"))
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.when(F.size("hits") >= c, F.array_distinct(F.flatten(F.transform(some, of)))).otherwise(F.array().cast("array<int>"))

    def best(found: Column) -> Column:
        inside = lambda s: F.size(F.filter("hits", lambda x: (x["pos"] >= s) & (x["pos"] < s + F.col("m"))))
        top = F.array_max(F.transform(found, lambda s: F.struct(inside(s).alias("n"), (-s).alias("s"))))
        return F.array(-top["s"])

    plain = (F.col("kinds") == F.col("n")) & (F.size(F.array_distinct(F.transform("hits", lambda x: x["h"]))) == F.size("hits"))
    return _let(_let(need, reach), lambda found: F.when(plain & (F.size(found) > 1), best(found)).otherwise(found))


def leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(text_hash, text_size, item_id, similarity, distance, start_word, n_words) per distinct text and item.

    The best window is reported: highest similarity, then the first.
    """
    parts = cut(item_shingles(items, item_id_col, item_text_col))
    short = [r["size"] for r in parts.where(F.col("size") < WIDTH).select("size").distinct().collect()]  # four values at most
    widths = [WIDTH, *sorted(short)]
    text = F.col(text_col)

    def all_shingles(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), *[shingles(words, w).alias(f"w{w}") for w in widths])

    texts = docs.select(*text_key(text), F.inline(F.array(_let(word_hashes(text), all_shingles)))).where("n_words > 0")
    about = parts.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("h").alias("kinds"))
    known = parts.select("h", "item", "size").distinct().join(about, "item")
    hits = None
    for w in widths:
        mine = light(known.where(F.col("size") >= WIDTH if w == WIDTH else F.col("size") == w))
        # a text in which an item stands has many of its shingles
        here = texts.select(*KEY, "n_words", F.size(f"w{w}").alias("total"), F.posexplode(f"w{w}").alias("pos", "h")).join(mine, "h")
        hits = here if hits is None else hits.unionByName(here)
    # a set, as equal texts bring the same places
    met = hits.groupBy(*KEY, "n_words", "total", "item", "size", "n", "kinds").agg(F.sort_array(F.collect_set(F.struct("pos", "h"))).alias("hits"))
    met = met.withColumn("m", F.least("n", "total"))
    laid = met.select(*KEY, "item", "size", F.least("size", "n_words").alias("length"), F.explode(starts(similarity)).alias("start"))
    laid = cut(laid)
    windows = laid.select(*KEY, "start", "size", "length").distinct()

    # texts with windows, each text once
    wanted = windows.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size", "length")).alias("windows"))
    wanted = F.broadcast(wanted) if laid.count() <= LIGHT_ROWS else wanted
    found = docs.select(*text_key(text), text.alias("text")).join(wanted, list(KEY)).dropDuplicates(list(KEY))
    cutout = F.when(F.col("size") >= WIDTH, F.slice(f"w{WIDTH}", F.col("start") + 1, F.col("length") - WIDTH + 1))
    for w in sorted(short):
        cutout = cutout.when(F.col("size") == w, F.slice(f"w{w}", F.col("start") + 1, F.lit(1)))
    spread = found.select(*KEY, "windows", F.inline(F.array(_let(word_hashes(F.col("text")), all_shingles))))
    place = [*KEY, "start", "size", "length"]
    bags = cut(spread.select("*", F.inline("windows")).select(*place, F.explode(cutout).alias("h")))

    window_fps = simhash_of(bags, place)
    item_fps = simhash_of(parts, ["item", "size"])
    probes = item_fps.select("item", "size", F.col("n").alias("item_n"), F.col("fp").alias("item_fp"), F.inline(_block_values(radius, blocks, True)))
    own = laid.join(window_fps, place).select(*place, "item", "n", "fp", F.inline(_block_values(radius, blocks, False)))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    candidates = own.join(probes, ["item", "size", "block", "value"]).where(distance <= radius)
    candidates = candidates.select(*place, "n", "item", "item_n", distance.alias("distance")).distinct()

    window_bag = bags.groupBy(*place, "h").agg(F.count(F.lit(1)).alias("c"))
    item_bag = parts.groupBy("item", "h").agg(F.count(F.lit(1)).alias("item_c"))
    common = candidates.join(window_bag, place).join(item_bag, ["item", "h"])
    scored = common.groupBy(*place, "n", "item", "item_n", "distance").agg(F.sum(F.least("c", "item_c")).alias("shared"))
    scored = scored.withColumn("similarity", F.col("shared") / (F.col("n") + F.col("item_n") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("similarity", "distance", "start", "length"), F.struct("similarity", -F.col("start")))
    hits = scored.groupBy(*KEY, "item").agg(best.alias("best"))
    return hits.select(*KEY, F.col("item").alias("item_id"), "best.similarity", "best.distance", F.col("best.start").alias("start_word"), F.col("best.length").alias("n_words"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, similarity, …): every document that contains an item, with each item."""
    hits = light(leaks(docs, items, text_col, **options))
    return docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col))).join(hits, list(KEY)).drop(*KEY)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item. Null texts stay."""
    names = [fresh(docs, f"_leak_{k}") for k in KEY]
    bad = light(leaks(docs, items, text_col, **options).select(*[F.col(k).alias(n) for k, n in zip(KEY, names)]).distinct())
    hash_, size = text_key(F.col(text_col))
    return docs.join(bad, (hash_ == F.col(names[0])) & (size == F.col(names[1])), "left_anti")
