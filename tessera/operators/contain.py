"""Which texts contain which names: automata over blocks of names, one pass over the texts a block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed

#: Characters of names that travel with a pass; more names make more passes.
BLOCK_CHARS = 1 << 20


def occurrences(texts: DataFrame, names: DataFrame, content: str = "content", name: str = "name", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of ``texts`` but ``content``, and ``name``: a row for each distinct name that occurs in a text.

    Null and empty names occur nowhere, null texts contain nothing. Names are a set of strings of known size: each block of
    at most about ``block_chars`` characters (or a single name) goes to the tasks whole.
    """
    distinct = checkpointed(names.select(F.col(name).alias("name")).where("name is not null and name != ''").distinct())
    size = distinct.agg(F.sum(F.length("name")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_chars)
    keys = [c for c in texts.columns if c != content]
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys) + ", name string"
    block = F.pmod(F.xxhash64("name"), F.lit(max(blocks, 1)))
    found = [texts.where(F.col(content).isNotNull()).mapInArrow(_search([r["name"] for r in distinct.where(block == b).collect()], keys, content), schema) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found) if found else texts.sparkSession.createDataFrame([], schema)


def _search(names: list[str], keys: list[str], content: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, n in enumerate(names):
            automaton.add_word(n, i)
        if names:
            automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column(content).to_pylist()):
                seen = {k for _, k in automaton.iter(text)} if names and text else ()
                rows += [i] * len(seen)
                hits += [names[k] for k in sorted(seen)]
            taken = batch.select(keys).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(hits, type=pa.string())], names=[*keys, "name"])

    return run
