"""Language identification by prediction by partial matching over bytes.

For each language, context trees of depth ``DEPTH`` hold how often each byte followed each context of up
to that many bytes. A byte is coded in the longest known context with probability n / (total + kinds);
a byte not seen there costs the escape kinds / (total + kinds) and is tried in the next shorter context,
at last in a uniform one over 256 bytes (escape method C). The statistics are frozen after training, so the
cost of a byte depends on it and the ``DEPTH`` bytes before only, and the exact code length of a text is a
sum of table entries. The language with the shortest code wins.

The tables hold the costs for all languages side by side. Contexts are numbered over the bytes that occur
in training, so that the tables grow with the distinct contexts of the training sample and not with the
corpus. Bytes and contexts never seen fall back to shorter contexts like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import light

DEPTH = 3
#: Bound of the training sample: texts per language, picked by hash. Prediction has no bound.
SAMPLE_PER_LANGUAGE = 1500
CHUNK = 1 << 19
UNKNOWN = "und"
_BOUNDARY = 0  # symbol before a text; bytes are 1..


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol, the last symbol stands for all unseen bytes
    context: np.ndarray  # symbol triple -> row of ``cost`` / symbols
    cost: np.ndarray  # (contexts * symbols, languages) in bits


def count_grams(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n): counts of every ``DEPTH`` + 1 bytes with what stands before a text as zeros.

    Partial counts leave the tasks, so the shuffle carries distinct grams and not positions.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(bytes(DEPTH) + text.encode("utf-8", "replace"))
            for lang, raws in by.items():
                raw = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.uint32)
                gram = raw[DEPTH:].copy()
                for d in range(1, DEPTH + 1):
                    gram += raw[DEPTH - d : len(raw) - d] << np.uint32(8 * d)
                last = np.cumsum([len(r) for r in raws])
                ok = np.ones(len(gram), dtype=bool)
                for d in range(DEPTH):
                    ok[(last[:-1] + d - DEPTH)] = False  # a position that would span two texts ends in a pad
                found, n = np.unique(gram[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n)], schema=schema)

    named = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text != ''")
    return named.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tables(grams: np.ndarray, n: np.ndarray, size: int, known: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Bits of (context row, symbol) for one language. ``grams`` columns: DEPTH context symbols, then the symbol."""
    cost = np.full((1, size), 8.0)  # order -1
    rows_of = np.zeros(len(known), dtype=np.int64)
    for order in range(DEPTH + 1):
        # contexts of this order: the last ``order`` symbols before the one coded
        weights = size ** np.arange(order)[::-1] if order else np.zeros(0, dtype=np.int64)
        ctx = grams[:, DEPTH - order : DEPTH] @ weights if order else np.zeros(len(grams), dtype=np.int64)
        seen, inverse = np.unique(ctx, return_inverse=True)
        counts = np.bincount(inverse * size + grams[:, DEPTH], n, len(seen) * size).reshape(len(seen), size)
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        # the shorter context of each context seen
        if order:
            shorter = seen % size ** (order - 1) if order > 1 else np.zeros(len(seen), dtype=np.int64)
            parent = cost[np.searchsorted(previous, shorter)]
        else:
            parent = np.broadcast_to(cost[:1], (len(seen), size))
        with np.errstate(divide="ignore"):
            own = -np.log2(counts / (total + kinds))
            escape = np.log2((total + kinds) / kinds)
        now = np.where(counts > 0, own, parent + escape)
        # every known triple: the longest context this language has seen
        key = known % size**order if order else np.zeros(len(known), dtype=np.int64)
        at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
        hit = seen[at] == key
        out = np.where(hit[:, None], now[at], out) if order else now[at]
        cost, previous = now, seen
    return out


def build(counts: pd.DataFrame) -> Model:
    """The tables from (lang, gram, n) rows."""
    languages = tuple(sorted(counts["lang"].unique()))
    gram = counts["gram"].to_numpy(dtype=np.int64)
    raw = np.stack([(gram >> (8 * d)) & 255 for d in range(DEPTH, -1, -1)], axis=1)
    present = np.unique(raw[raw > 0])
    symbol = np.full(256, len(present) + 1, dtype=np.int64)
    symbol[present] = np.arange(1, len(present) + 1)
    symbol[0] = _BOUNDARY
    size = len(present) + 2
    coded = symbol[raw]
    weights = size ** np.arange(DEPTH)[::-1]
    known = np.unique(coded[:, :DEPTH] @ weights)
    # contexts no language has seen whole stand for their shorter ends: one row per pair as well
    pairs = np.unique(known % size**2)
    singles = np.arange(size)
    of = counts["lang"].to_numpy()
    n = counts["n"].to_numpy(dtype=np.float64)
    never = size - 1
    rows = np.concatenate([known, never * size**2 + pairs, never * size**2 + never * size + singles])
    rows = np.unique(rows)
    cost = np.stack([_tables(coded[of == lang], n[of == lang], size, rows, symbol) for lang in languages], axis=2)
    context = np.full(size**DEPTH, -1, dtype=np.int32)
    context[rows] = np.arange(len(rows))
    grid = np.arange(size**DEPTH)
    pair_row = context[never * size**2 + grid % size**2]
    single_row = context[never * size**2 + never * size + grid % size]
    context = np.where(context >= 0, context, np.where(pair_row >= 0, pair_row, single_row)).astype(np.int32)
    return Model(languages, symbol.astype(np.int32), context, cost.reshape(-1, len(languages)).astype(np.float32))


def code_lengths(texts: list[bytes], model: Model) -> np.ndarray:
    """Bits of each text under each language: exact sums over all its bytes."""
    size, out = int(model.symbol.max()) + 1, np.zeros((len(texts), len(model.languages)))
    for k, raw in enumerate(texts):
        before = np.zeros(DEPTH, dtype=np.int32)
        for at in range(0, len(raw), CHUNK):
            s = np.concatenate([before, model.symbol[np.frombuffer(raw, dtype=np.uint8, count=min(CHUNK, len(raw) - at), offset=at)]])
            triple = (s[: -DEPTH] * size + s[1 : 1 - DEPTH]) * size + s[2 : 2 - DEPTH]
            index = model.context[triple] * size + s[DEPTH:]
            out[k] += model.cost.take(index, axis=0).sum(axis=0, dtype=np.float64)
            before = s[-DEPTH:]
    return out


def sample(docs: DataFrame, allowed: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` texts of each language, by a threshold on the hash of the id: rows that share an id are all
    taken or all left, rows with a null id, language or text are left."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(allowed).where("lang is not null and text is not null")
    # a row for each language: few, so the texts are not dealt out by language
    share = light(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count(F.lit(1))).alias("share")))
    picked = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    return rows.join(share, "lang").where(picked).select("lang", "text")


def fit(docs: DataFrame, allowed: Column, **options) -> Model | None:
    counts = count_grams(sample(docs, allowed, **options)).toPandas()
    return build(counts.sort_values(["lang", "gram"], ignore_index=True)) if len(counts) else None


def predict_column(text: Column, model: Model | None) -> Column:
    """struct(lang, score): the language of the whole text and its posterior under equal priors.

    ``und`` with score 0 for a null text, a text without a letter, and where nothing was learned. Of languages with equally
    long codes the first by name is taken. Rows are treated one by one, so repeated rows have equal results; an empty
    table stays empty; other columns are left alone, whatever their names.
    """
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        bits = code_lengths([(t or "").encode("utf-8", "replace") for t in texts], model)
        odds = np.exp2(bits.min(axis=1, keepdims=True) - bits)
        best = bits.argmin(axis=1)
        return pd.DataFrame({"lang": np.array(model.languages, dtype=object)[best], "score": odds[np.arange(len(best)), best] / odds.sum(axis=1)})

    return F.when(text.isNotNull() & text.rlike(r"\p{L}"), run(text)).otherwise(nothing)
