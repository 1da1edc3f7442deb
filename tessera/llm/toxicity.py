"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax, trained jointly.

A word is the mean of the vectors of its character n-grams (3 to 5 code points, lower case, white space and
punctuation mark word edges, hashed into ``BUCKETS`` rows). The words of a passage of ``PASSAGE`` words are averaged
and go through a linear layer and a two-way softmax. A text scores as its most toxic passage, over
passages at every word, so that a few words in a very long text are not averaged away. Vectors and the
linear layer are trained together in numpy; misspelt and unseen words share n-grams with known ones.

For scoring, the linear layer is folded into the vectors: each bucket keeps one number, and passages are
prefix sums over them. This is the same function, without the width of the vectors.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
PASSAGE = 8
#: Bound of the labelled sample the model is fitted on, per label. Scoring has no bound.
SAMPLE_PER_LABEL = 2000
CHUNK = 1 << 20
#: Times in an epoch that the passages to learn from are chosen anew.
RENEWALS = 3
#: Part of the epochs whose passages are chosen by how the words spread over the labels, before the vectors can tell.
WARM_SHARE = 3
#: Weight of a text of label 1 none of whose passages stands out more than those of nearly all texts of label 0.
PLAIN_WEIGHT = 0.2
#: Small samples are gone through more often, so that the layer still gets this many steps.
LEAST_STEPS = 300
MOST_EPOCHS = 60
_SPACE = 32


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # per bucket
    bias: float


#: Punctuation of ASCII parts words as white space does.
_GAPS = str.maketrans(dict.fromkeys(string.punctuation, " "))


def _split(text: str) -> list[str]:
    return text.lower().translate(_GAPS).split()


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with one space at either end and for each run of white space and punctuation."""
    return np.frombuffer(f" {' '.join(_split(text))} ".encode("utf-32-le", "replace"), dtype=np.uint32)


def _grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n: bucket of the n-gram at each position and whether it is one (no space but at its ends)."""
    space = codes == _SPACE
    inner = np.cumsum(space)
    h = codes.astype(np.uint32)
    for n in range(2, min(max(SIZES), len(codes)) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ codes[n - 1 :] * np.uint32(0x9E3779B1)
        if n in SIZES:
            mixed = h ^ (h >> np.uint32(15))
            mixed = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(14)
            whole = inner[n - 2 : len(codes) - 1] == inner[: len(codes) - n + 1]  # no space at 1..n-2
            yield mixed & np.uint32(BUCKETS - 1), whole


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start (at its leading space) and end (past its last character) of each word."""
    gaps = np.flatnonzero(codes == _SPACE)
    return gaps[:-1], gaps[1:]


def _word_means(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of each word; every n-gram belongs to the word it starts in or before."""
    starts, ends = _words(codes)
    total, count = np.zeros(len(codes) + 1), np.zeros(len(codes) + 1, dtype=np.int64)
    for bucket, whole in _grams(codes):
        values = np.where(whole, weight[bucket], 0.0)
        total[1 : len(values) + 1] += values
        count[1 : len(whole) + 1] += whole
    np.cumsum(total, out=total)
    np.cumsum(count, out=count)
    return (total[ends] - total[starts]) / np.maximum(count[ends] - count[starts], 1)


def logits(texts: list[str | None], model: Model) -> np.ndarray:
    """One logit per text: the bias for texts without words, else of the most toxic passage."""
    out = np.full(len(texts), model.bias)
    batch: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not batch:
            return
        # each text begins with the space that ends the one before, so one array holds them all
        codes = np.concatenate([batch[0][1][:1], *[c[1:] for _, c in batch]])
        means = _word_means(codes, model.weight)
        counts = np.array([np.count_nonzero(c == _SPACE) - 1 for _, c in batch])
        ends = np.cumsum(counts)
        sums = np.r_[0.0, np.cumsum(means)]
        first = np.arange(len(means)) - np.repeat(ends - counts, counts)
        begin = np.arange(len(means)) - np.minimum(first, PASSAGE - 1)
        width = np.arange(len(means)) - begin + 1
        passage = (sums[1:] - sums[begin]) / width
        short = np.repeat(counts, counts) < PASSAGE
        last = first == np.repeat(counts, counts) - 1
        passage[~(width == PASSAGE) & ~(short & last)] = -np.inf
        best = np.maximum.reduceat(passage, ends - counts)
        out[[i for i, _ in batch]] = best + model.bias
        batch.clear()
        size = 0

    for i, t in enumerate(texts):
        c = _codes(t or "")
        if len(c) > 2:
            batch.append((i, c))
            size += len(c)
            if size > CHUNK:
                flush()
    flush()
    return out


def _tokenised(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per text the word ids of the whole text; the n-grams of the distinct words end to end, and where each word's begin."""
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in _split(t)], dtype=np.int32) for t in texts]
    blocks, sizes = [np.zeros(0, dtype=np.int32)], np.zeros(len(ids), dtype=np.int64)
    words = list(ids)
    del ids
    for k in range(0, len(words), 4096):
        grams = []
        for i, w in enumerate(words[k : k + 4096], k):
            found = [b[m] for b, m in _grams(_codes(w))] if w else []
            sizes[i] = sum(map(len, found))
            grams += found
        if grams:
            blocks.append(np.concatenate(grams).astype(np.int32))
    return docs, np.concatenate(blocks), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _telling(docs: list[np.ndarray], labels: np.ndarray, words: int) -> np.ndarray:
    """Per word, by how many standard deviations more texts of label 1 have it than its number of texts makes one expect."""
    of = [np.zeros(words, dtype=np.int64), np.zeros(words, dtype=np.int64)]
    for d, label in zip(docs, labels):
        of[label][np.unique(d)] += 1
    expected = (of[0] + of[1]) * labels.mean()
    return (of[1] - expected) / np.sqrt(expected + 1.0)


def train(texts: list[str], labels: list[int], width: int = 16, epochs: int = 9, batch: int = 128, rate: float = 0.5, seed: int = 7) -> Model:
    """Adagrad on the softmax loss of each text's most toxic passage; the rarer class weighs more.

    A whole text is searched for its passage: at first by which words stand out in texts of label 1, then by the vectors."""
    labels_ = np.asarray(labels, dtype=np.int64)
    if not len(labels_) or labels_.min() == labels_.max():
        constant = 0.0 if not len(labels_) else (4.0 if labels_[0] else -4.0)
        return Model(np.zeros(BUCKETS), constant)
    docs, flat, starts = _tokenised(texts)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    layer = np.zeros((width, 2), dtype=np.float32)
    layer[:, 1] = rng.normal(0, 0.5, width)
    bias = np.zeros(2, dtype=np.float32)
    seen_v, seen_l, seen_b = np.full(BUCKETS, 1e-2, dtype=np.float32), np.full((width, 2), 1e-2, dtype=np.float32), np.full(2, 1e-2, dtype=np.float32)
    balance = len(labels_) / (2.0 * np.bincount(labels_, minlength=2))

    def gather(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-gram ids of ``words`` end to end, and the word each belongs to."""
        n = starts[words + 1] - starts[words]
        owner = np.repeat(np.arange(len(words)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return flat[starts[words][owner] + inside], owner

    telling = _telling(docs, labels_, len(starts) - 1)

    def standing_out() -> np.ndarray:
        """Weight of each text: labels that no word of the text tells are learned from less."""
        top = np.array([np.convolve(telling[d], np.ones(min(len(d), PASSAGE)), "valid").max() if len(d) else -np.inf for d in docs])
        usual = np.quantile(top[labels_ == 0], 0.99)
        return np.where((labels_ == 1) & (top <= usual), PLAIN_WEIGHT, 1.0)

    weight = standing_out()

    def best_passages(warm: bool) -> list[np.ndarray]:
        """The most toxic passage of each text, by the words' spread or under the vectors as they are."""
        if warm:
            mean = telling
        else:
            folded = vectors @ (layer[:, 1] - layer[:, 0])
            mean = np.add.reduceat(folded[flat], starts[:-1]) if len(flat) else np.zeros(0)
            mean = mean / np.maximum(np.diff(starts), 1)
        found = []
        for d in docs:
            if len(d) > PASSAGE:
                sums = np.r_[0.0, np.cumsum(mean[d])]
                k = int(np.argmax(sums[PASSAGE:] - sums[:-PASSAGE]))
                d = d[k : k + PASSAGE]
            found.append(d)
        return found

    usable = np.array([i for i, d in enumerate(docs) if len(d)])
    epochs = max(epochs, min(MOST_EPOCHS, -(-LEAST_STEPS * batch // len(usable)))) if len(usable) else 0
    for epoch in range(epochs):
        order = rng.permutation(usable)
        renew = batch * max(1, len(order) // batch // RENEWALS)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            if k % renew == 0:
                passages = best_passages(epoch * WARM_SHARE < epochs)
            chosen = [passages[i] for i in part]
            tokens = np.concatenate(chosen)
            of_doc = np.repeat(np.arange(len(part)), [len(c) for c in chosen])
            g, owner = gather(tokens)
            share = 1.0 / (np.maximum(starts[tokens + 1] - starts[tokens], 1)[owner] * np.array([len(c) for c in chosen])[of_doc][owner])
            target = of_doc[owner]
            hidden = np.stack([np.bincount(target, vectors[g, j] * share, len(part)) for j in range(width)], axis=1)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            y = labels_[part]
            p[np.arange(len(part)), y] -= 1.0
            p *= (balance[y] * weight[part])[:, None]
            step = rate * (1 - epoch / epochs)
            back = (p @ layer.T)[target] * share[:, None]
            rows, inverse = np.unique(g, return_inverse=True)
            grad = np.stack([np.bincount(inverse, back[:, j], len(rows)) for j in range(width)], axis=1)
            seen_v[rows] += (grad**2).mean(axis=1)
            vectors[rows] -= step * grad / np.sqrt(seen_v[rows])[:, None]
            for value, gradient, seen in ((layer, hidden.T @ p / len(part), seen_l), (bias, p.mean(axis=0), seen_b)):
                seen += gradient**2
                value -= 0.1 * step * gradient / np.sqrt(seen)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> pd.DataFrame:
    """text and label of about ``per_label`` rows of each label, picked by the hash of the id.

    Rows with a null id or label, and ids with contradicting labels, are left out; of different texts under one id the
    least is taken. The pick is a threshold on the hash, so no sort or window over the labels is needed; ids on the
    same side of it are all taken, and the order of the result is fixed.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi"))
    known = known.where("lo = hi and lo in (0, 1)").select(F.col(id_col).alias("id"), F.col("lo").cast("int").alias("label")).where(allowed)
    spread = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 20))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    pick = F.lit(False)
    for label, n in sizes.items():
        pick = pick | ((F.col("label") == label) & (spread < min(1.0, per_label / n) * (1 << 20)))
    # about 2 * per_label ids, so they go to the scan of the texts and not the texts to them
    chosen = known.where(pick).toPandas()
    if not len(chosen):
        return pd.DataFrame({"id": [], "label": [], "text": []})
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, known.schema))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(ids, "id").groupBy("id", "label").agg(F.min("text").alias("text")).toPandas()
    return rows.sort_values("id", ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, **options) -> Model:
    rows = labelled_sample(docs, labels, allowed, **options)
    texts, marks = rows["text"].tolist(), rows["label"].tolist()
    del rows
    model = train(texts, marks)
    del texts, marks
    released()
    return model


def score_column(text: Column, model: Model) -> Column:
    """Probability of label 1, from the whole text. Null and empty texts score as a text without words; repeated rows
    score alike, an empty table stays empty and other columns are left alone."""
    weight, bias = model.weight.astype(np.float32), model.bias

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        z = logits(texts.tolist(), Model(weight, bias))
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))

    return run(text)
