"""The stages one after the other, and each on odd rows."""

import corpus_pipeline
from test_simhash import classes, similar_pairs
from test_toxicity import MARKS

from tessera.llm import decontam


def test_stages_keep_their_word(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == columns
    assert kept[0] >= kept[1] >= kept[2] == kept[3] == kept[4]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(i in kept[0] for i, t in toxic.items() if t == 0) / sum(t == 0 for t in toxic.values()) > 0.98
    marked = [i for i, t in toxic.items() if t == 1 and any(w in texts[i].lower() for w in MARKS)]
    assert sum(i in kept[0] for i in marked) / len(marked) < 0.1
    before = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (%s)" % ",".join(map(str, kept[0])))
    left = {i: texts[i] for i in kept[0]}
    assert kept[1] == {i for i, c in classes(left, similar_pairs(left)).items() if i == c}
    leaks = {r.id for r in decontam.report(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert kept[1] - leaks == kept[2]
    for r in docs.collect():
        assert "@mail" not in r.text and (r.text == texts[r.doc_id] or "[" in r.text) and len(r.ids) == r.n_tokens


def test_odd_rows(spark, odd, sf):
    for rows in (odd, odd.where("false")):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() <= rows.count()
