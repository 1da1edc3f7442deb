"""The folded, batched score against the unfolded average; held-out accuracy; misspellings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, toxicity


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    calm = ["river stone maple", "garden window lamp", "table chair bottle", "cloud paper candle"]
    bad = ["stupid idiot", "worthless moron", "pathetic scum", "idiot loser"]
    texts, labels = [], []
    for k in range(400):
        words = " ".join(rng.choice(calm, rng.integers(1, 12))).split()
        if k % 2:
            for w in str(rng.choice(bad)).split():
                words.insert(int(rng.integers(0, len(words) + 1)), w)
        texts.append(" ".join(words))
        labels.append(k % 2)
    return toxicity.train(texts, labels)


def plain(text, model):
    words = (text or "").lower().split()
    if not words:
        return model.bias
    means = []
    for w in words:
        s = f" {w} "
        grams = [g for n in toxicity.SIZES for g in (s[i : i + n] for i in range(len(s) - n + 1))]
        values = []
        for g in grams:
            c = np.frombuffer(g.encode("utf-32-le"), dtype=np.uint32)
            bucket = [b for b, _ in toxicity._grams(c)][-1]
            values.append(model.weight[bucket[0]])
        means.append(np.mean(values))
    k = min(len(means), toxicity.PASSAGE)
    return max(np.mean(means[i : i + k]) for i in range(len(means) - k + 1)) + model.bias


def test_same_as_unfolded(model):
    texts = ["you idiot", "", None, "  ", "a", "river " * 30 + "stupid moron " + "lamp " * 30, "é 🎉 x", "ONE two\tthree\nfour"]
    assert toxicity.logits(texts, model) == pytest.approx([plain(t, model) for t in texts])


def test_misspellings_and_dilution(model):
    z = toxicity.logits(["stupidd idiott", "river maple lamp", "river " * 5000 + "stupid idiot " + "lamp " * 5000], model)
    assert z[0] > 0 and z[1] < 0 and z[2] > 0


def test_batches_agree(model, monkeypatch):
    texts = [f"river {i} stupid" for i in range(50)]
    whole = toxicity.logits(texts, model)
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    assert toxicity.logits(texts, model) == pytest.approx(whole)


def test_one_label_or_none():
    assert toxicity.train([], []).bias == 0 and toxicity.train(["a b"], [0]).bias < 0 < toxicity.train(["a b"], [1]).bias


#: The words that mark a text as toxic in the tables; of sf0.1, 188 of 449 toxic labels are on texts without any.
MARKS = "idiot scum pathetic loser moron disgusting trash stupid worthless".split()


def test_held_out_accuracy(spark):
    """Over labels that the text can tell: toxic texts without a mark cannot be told from others."""
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lower("text").rlike("|".join(MARKS)).alias("marked"))
    got = queries.op8_toxicity(spark, sf).join(truth, "doc_id").join(texts, "doc_id").where("held_out").collect()
    told = [r for r in got if r.marked or not r.toxic]
    assert sum(r.predicted == r.toxic for r in told) / len(told) > 0.97
    assert sum(r.predicted for r in told if r.marked) / sum(r.marked for r in told) > 0.95
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.94


def test_texts_are_learned_whole():
    """The mark of a long text stands at its very end."""
    rng = np.random.default_rng(1)
    filler = [f"w{i}" for i in range(300)]
    long = [" ".join(rng.choice(filler, 4000)) for _ in range(60)]
    model = toxicity.train([f"{t} wicked fiend" if k % 2 else t for k, t in enumerate(long)], [k % 2 for k in range(60)])
    z = toxicity.logits(["wicked fiend", " ".join(filler[:50])], model)
    assert z[0] > 0 > z[1]


def test_every_word_is_looked_at():
    """Every word of a long text is among what training looks at, each with all its n-grams."""
    texts = [" ".join(f"w{i}" for i in range(30_000)) + " wicked fiend", "short"]
    docs, flat, starts = toxicity._tokenised(texts)
    assert [len(d) for d in docs] == [30_002, 1] and len(starts) == 30_003 + 1
    for word, i in (("wicked", docs[0][-2]), ("short", docs[1][0])):
        grams = np.concatenate([b[m] for b, m in toxicity._grams(toxicity._codes(word))])
        assert flat[starts[i] : starts[i + 1]].tolist() == grams.tolist()


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (5, None), (7, 0), (99, 1)], "doc_id long, toxic int")
    m = toxicity.fit(odd, labels, F.lit(True))
    scores = [r.s for r in odd.select(toxicity.score_column(F.col("text"), m).alias("s")).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.fit(odd.where("false"), labels, F.lit(True)).bias == 0
