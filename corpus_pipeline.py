"""From raw documents to token ids: toxicity, near-duplicates, benchmark leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and, but for the last,
returns the columns of ``documents``. Null texts pass every filter as empty ones; extra columns are kept, whatever their names; an empty
table stays empty. Rows that are equal in id and text have the same fate, but for the near-duplicate stage, which keeps one
of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, pii, simhash, toxicity
from tessera.llm.common import read_table, stored

#: Documents at or above this probability go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on four fifths of the labels, score every text, keep those below ``TOXIC``; one at it goes. Without labels all stay."""
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), learn)
    return docs.where(toxicity.score_column(F.col("text"), model) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are alike in 0.8 or more of their 5-word shingles stays: the one with the
    smallest id, ties by the key of the text; a row without an id only if the whole group has none. Texts without words are
    a group."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, or a window of 0.8 or more of its shingles, go, and copies of them as well."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text."""
    shown = {"text": pii.redacted(F.col("text"))}
    docs = docs.withColumns(shown)
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text as decoded from the ids: a row for each document left, an empty one for a null text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(docs, path, pattern, raw=True)
    return tokens.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("raw").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("bpe", tokenise),
]

#: No stage but the fourth can be expressed in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
