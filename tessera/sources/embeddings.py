"""Model boundaries: embedding and text generation, run per Arrow batch on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
TextGenerator = Callable[[list[str]], list[str]]
EMBED_BATCH = 32


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in: signed counts of hashed words at length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return embed


def embed_column(text: Column, load: Callable[[], Embedder], batch: int = EMBED_BATCH) -> Column:
    """``load`` runs once per task, the model it gives once per ``batch`` texts. Null texts embed as empty ones."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])], dtype=object)

    return run(text)


def no_text(prompts: list[str]) -> list[str]:
    """The generator used where there is no model: nothing, so that fallbacks apply."""
    return ["" for _ in prompts]


def generate_column(prompt: Column, generator: TextGenerator = no_text) -> Column:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(generator(prompts.fillna("").tolist()))

    return run(prompt)


def enrich(chunks: DataFrame, generator: TextGenerator = no_text, content: str = "content", most: int = 450) -> DataFrame:
    """``chunks`` with a ``summary`` generated from the first ``most`` signs; null where the generator gives none."""
    said = generate_column(F.substring(content, 1, most), generator)
    return chunks.withColumn("summary", F.nullif(said, F.lit("")))
