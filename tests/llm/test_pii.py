"""Base spans against a brute-force search; validators; redaction."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, sf).collect():
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in PLAIN)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f x@y.zz a@b", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "é+1 (988) 555-2485, +12 34", " ".join(f"u{i}@h{i}.org" for i in range(700)), "1" * 5000 + "@" * 3000, "+1" * 800, "a.b" + ".c" * 9000 + "@x" + ".y" * 9000])
def test_edges(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.find(df).select(pii.listed(tuple(k for k in pii.KINDS if k.base)).alias("s")).first()
    assert r.s == ",".join(brute(text))


def test_added_kinds_and_redaction(spark):
    df = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013001"), (2, "my ssn: 123-45-6789; order 123-45-6789"), (3, "mail a@b.co now"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.listed().alias("s")).collect()}
    assert got[1] == "iban:5:32" and got[2] == "national_id:8:19" and got[4] == ""
    red = {r.doc_id: r.t for r in df.select("doc_id", pii.redacted(F.col("text")).alias("t")).collect()}
    assert red[3] == "mail [EMAIL] now" and red[4] is None and red[1].startswith("iban [IBAN] and DE89")


def spans_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(pii.find(df).select("doc_id", pii.listed().alias("s"), pii.listed_scores().alias("c")).collect())
    return [(r.s, r.c) for r in rows]


def test_context_on_both_sides_and_across_matches(spark):
    two = "My amex cards are 378282246310005 and 371449635398431 both"
    behind, far = "378282246310005 is my amex card", "378282246310005 and quite a lot later in this text a card"
    got = spans_of(spark, two, behind, far, "serial 378282246310005 card", "GB82 WEST 1234 5698 7654 32", "order GB82 WEST 1234 5698 7654 32")
    assert [s for s, _ in got] == ["short_card:18:33,short_card:38:53", "short_card:0:15", "", "", "iban:0:27", ""]
    assert got[0][1] == "0.80,0.80" and got[4][1] == "0.80"


def test_secrets(spark):
    hidden = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    got = spans_of(spark, f'token = "{hidden}" x', f"checksum {hidden}", f"commit {hidden} token", "token = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", f"api_key:{hidden}")
    assert [s for s, _ in got] == ["secret:9:49", "", "", "", "secret:8:48"]


def test_redaction_takes_the_reported_spans(spark):
    """Also where spans overlap, and in a text of many blocks."""
    long = "é" * 5000 + " a@b.co " + "x " * 5000 + "+1 (988) 555-2485 " + "y" * 9000 + " 10.0.0.1"
    texts = ["call +4111111111111111 now", "a@1.2.3.4.5", "nothing", "", long, " ".join(f"u{i}@h{i}.org" for i in range(700)), "10.0.0.1 a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    red = {r.doc_id: r.t for r in df.select("doc_id", pii.redacted(F.col("text")).alias("t")).collect()}
    for i, (t, (s, _)) in enumerate(zip(texts, spans_of(spark, *texts))):
        spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in s.split(",") if x))
        merged = []
        for a, b, k in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -b)
            else:
                merged.append([a, -b, k])
        want, at = "", 0
        for a, b, k in merged:
            want, at = want + t[at:a] + f"[{k.upper()}]", b
        assert red[i] == want + t[at:]


def test_odd_rows(spark, odd):
    got = pii.find(odd).collect()
    assert len(got) == odd.count()
    assert pii.find(odd.where("false")).count() == 0
