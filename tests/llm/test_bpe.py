"""Against the tiktoken library, whole texts and stitched chunks; exact round trips."""

import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
WHOLE = bpe.Codec(PATH, PATTERN)
SIGNS = st.text(alphabet="ab  \n\t\r'sltve1２.!é你🎉<|>", max_size=120)


@settings(max_examples=400, deadline=None)
@given(SIGNS)
def test_like_the_library(text):
    want = REFERENCE.encode_ordinary(text)
    assert WHOLE.encode(text).tolist() == want
    assert WHOLE.decode(want) == text.encode()
    # a piece between two boundaries has the same ids by itself
    cuts = [0, *WHOLE.boundaries(text).tolist()[::2], len(text)]
    assert [i for a, b in zip(cuts, cuts[1:]) for i in WHOLE.encode(text[a:b]).tolist()] == want


def awkward(n, seed):
    rng = random.Random(seed)
    signs = "ab  \n\t\r'sltve1２.!é你🎉<|>"
    return "".join(rng.choice(signs) * rng.choice((1, 1, 1, 2, 40)) if rng.random() < 0.5 else rng.choice([" we'll", " say", " 1234567", "\n\n  ", "......"]) for _ in range(n))


RUNS = ["a" * 500, " " * 300 + "x", "x" + "\n" * 300, ("ab " * 40 + " " * 40) * 5, "1" * 200 + " " * 200, "<|endoftext|>", "we'll " * 60, "x" * 64, "x" * 65]


def test_chunks_meet(spark):
    texts = RUNS + [awkward(120, s) for s in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((64, 32), (32, 20), (18, 17), (200, 64)):
        got = {r.id: (r.ids, bytes(r.raw)) for r in bpe.encode(rows, PATH, PATTERN, raw=True, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: (REFERENCE.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}


def test_long_texts_go_by_chunks(spark, monkeypatch):
    """With the stitching gone wrong, the results of long texts go wrong: nothing else makes them."""
    prose = " ".join(f"word{i} we'll" for i in range(5000))
    rows = spark.createDataFrame([(1, prose), (2, "short")], "doc_id long, text string")
    want = {1: REFERENCE.encode_ordinary(prose), 2: REFERENCE.encode_ordinary("short")}
    right = bpe.chunk_rows
    assert {r.id: r.ids for r in bpe.encode(rows, PATH, PATTERN).collect()} == want
    assert right(rows.selectExpr("doc_id as row", "doc_id as id", "text"), bpe.CHUNK, bpe.OVERLAP).count() > 5
    monkeypatch.setattr(bpe, "chunk_rows", lambda texts, chunk, overlap: right(texts, chunk, overlap).where("k != 1"))
    wrong = {r.id: r.ids for r in bpe.encode(rows, PATH, PATTERN).collect()}
    assert wrong[2] == want[2] and wrong[1] != want[1]


def test_chunks_overlap_and_cover():
    for text in RUNS + [awkward(200, s) for s in range(20)]:
        spans = list(bpe.chunk_spans(text, 40, 20))
        assert spans[0][0] == 0 and spans[-1][1:] == (len(text), -1)
        for (begin, end, then), (following, _, _) in zip(spans, spans[1:]):
            assert begin < then == following < end


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op9_bpe(spark, sf).collect():
        want = REFERENCE.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(" ".join(map(str, want)).encode()), sha(docs[r.doc_id].encode()))


def test_odd_rows(spark, odd):
    out = bpe.encode(odd, PATH, PATTERN, raw=True).collect()
    assert len(out) == odd.count()
    assert sorted(bytes(r.raw).decode() for r in out) == sorted(r.text or "" for r in odd.collect())
    assert sorted(r.ids for r in bpe.decode(bpe.encode(odd, PATH, PATTERN), PATH, PATTERN).collect()) == sorted(r.ids for r in out)
    assert bpe.encode(odd.where("false"), PATH, PATTERN, raw=True).count() == 0
