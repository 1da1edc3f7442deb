"""Code lengths against a plain byte-by-byte coder; held-out accuracy."""

from collections import defaultdict
from math import log2

import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, queries


@pytest.fixture(scope="module")
def counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return langid.count_grams(langid.sample(docs, F.lit(True))).toPandas()


def plain_bits(counts, lang, raw):
    tree = [defaultdict(lambda: defaultdict(int)) for _ in range(langid.DEPTH + 1)]
    for gram, n in counts.loc[counts.lang == lang, ["gram", "n"]].itertuples(index=False):
        b = [(int(gram) >> 8 * k) & 255 for k in range(langid.DEPTH, -1, -1)]
        for o in range(langid.DEPTH + 1):
            tree[o][tuple(b[langid.DEPTH - o : langid.DEPTH])][b[-1]] += int(n)
    seen, bits = [0] * langid.DEPTH, 0.0
    for c in raw:
        for o in range(langid.DEPTH, -1, -1):
            row = tree[o].get(tuple(seen[langid.DEPTH - o :]))
            if row is None:
                continue
            total = sum(row.values()) + len(row)
            if c in row:
                bits -= log2(row[c] / total)
                break
            bits += log2(total / len(row))
        else:
            bits += 8
        seen = [*seen[1:], c]
    return bits


@pytest.mark.parametrize("text", ["Bonjour à tous les amis", "你好 zzzq", "the quick brown", "", "x"])
def test_exact_code_length(counts, text):
    model = langid.build(counts)
    got = langid.code_lengths([text.encode()], model)[0]
    for k, lang in enumerate(model.languages):
        assert got[k] == pytest.approx(plain_bits(counts, lang, text.encode()), rel=1e-5, abs=1e-3)


def test_long_texts_are_coded_whole(counts, monkeypatch):
    model = langid.build(counts)
    raw = ("der die das und " * 500).encode()
    whole = langid.code_lengths([raw], model)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert langid.code_lengths([raw], model) == pytest.approx(whole, rel=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_langid(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_odd_rows(spark, odd):
    model = langid.fit(odd, F.lit(True))
    got = odd.select("doc_id", "text", langid.predict_column(F.col("text"), model).alias("p")).collect()
    assert len(got) == odd.count()
    assert all((r.p.lang == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) and 0 <= r.p.score <= 1 for r in got)
    assert langid.fit(odd.where("false"), F.lit(True)) is None
    assert odd.select(langid.predict_column(F.col("text"), None).alias("p")).first().p.lang == "und"
