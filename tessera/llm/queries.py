"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, codes, decontam, langid, lexical, license, mainhtml, minhash, pii, simhash, suffixes, topk, toxicity
from tessera.llm.common import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tuple(k for k in pii.KINDS if k.base)
    return pii.find(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed().alias("spans"),
        sum((F.size(k.name) for k in pii.KINDS), F.lit(0)).cast("long").alias("n_spans"),
        pii.listed_scores().alias("scores"),
    )


def _crc(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, _crc("id", 3) != 1)
    found = docs.select("doc_id", F.coalesce(_crc("doc_id", 3) == 1, F.lit(False)).alias("held_out"), langid.predict_column(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op3_mainhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.topk(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id AS id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, q.r AS r, c.id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").withColumn("similarity", F.round("similarity", 6))


def _stretches(col: str):
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "same_as",
        F.col("words").cast("long").alias("n_words"),
        F.aggregate("repeated", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long").alias("n_repeated"),
        _stretches("repeated").alias("repeated"),
        _stretches("later").alias("later"),
    )


def document_path(doc_id):
    """`source/lang/<id>.txt` for ids that end in 00, one folder down for those that end in 0, two for the others."""
    n = lambda k: F.floor(doc_id / k).cast("string")
    deeper = F.when(doc_id % 100 == 0, F.array()).when(doc_id % 10 == 0, F.array(n(100))).otherwise(F.array(n(100), n(10)))
    return F.array_join(F.concat(F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))), deeper, F.array(F.concat(doc_id.cast("string"), F.lit(".txt")))), "/")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree; one without a notice takes the best notice of the nearest folder that has one.

    A document without an id has no path, so it inherits nothing."""
    files = read_table(spark, sf_dir, "documents").select("doc_id", document_path(F.col("doc_id")).alias("path"), "text")
    return license.scan(files, "doc_id", "path", "text", F.lit(True)).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), _crc("id", 5) != 0)
    scored = docs.select("doc_id", F.coalesce(_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"), toxicity.score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(read_table(spark, sf_dir, "documents"), path, pattern, raw=True)
    return tokens.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, text, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
w AS (SELECT item_id, text, term, count(*) * floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), s GROUP BY item_id, text, term, n, df),
scored AS (
  SELECT item_id, text, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms) * n) // l))))::BIGINT AS score
  FROM w JOIN tf USING (term) JOIN d USING (r), s GROUP BY item_id, text, doc_id, r
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.minhash_groups(read_table(spark, sf_dir, "documents"))
    kept = F.col("id").eqNullSafe(F.col("component"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


OP12_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), h AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM w WHERE len(w) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM n
  UNION
  SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node WHERE r.root < e.b
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = w.doc_id
"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.encode(read_table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.col("digest").alias("codebooks_sha256"))


def _op13_sql() -> str:
    """Six rounds over all entries, for vectors of one dimension that eight divides."""
    nearest = """a{n} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, d) AS entry, min(d.d) AS error FROM (
    SELECT p.r, p.part, c.entry, {{'d': sum((p.x - c.x) * (p.x - c.x)), 'e': c.entry}} AS d FROM p JOIN c{n} c USING (part, place) GROUP BY p.r, p.part, c.entry
  ) GROUP BY r, part
)"""
    moved = """c{m} AS MATERIALIZED (
  SELECT part, place, entry, coalesce(m.x, c.x) AS x FROM c{n} c
  LEFT JOIN (SELECT part, place, entry, floor(sum(x) / count(*))::BIGINT AS x FROM p JOIN a{n} USING (r, part) GROUP BY part, place, entry) m USING (part, place, entry)
)"""
    steps = [s.format(n=n, m=n + 1) for n in range(codes.ROUNDS) for s in (nearest, moved)] + [nearest.format(n=codes.ROUNDS)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, (i - 1) // (len(v) // {codes.PARTS}) AS part, (i - 1) % (len(v) // {codes.PARTS}) AS place, v[i] AS x FROM (SELECT r, v, unnest(generate_series(1, len(v))) AS i FROM v)
), c0 AS MATERIALIZED (SELECT part, place, r AS entry, x FROM p WHERE r < {codes.ENTRIES}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY r),
total AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN v USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM c{codes.ROUNDS}) AS codebooks_sha256
FROM coded JOIN v USING (r) JOIN total t ON t.label IS NOT DISTINCT FROM v.label
"""


QUERIES = {
    "op1_pii": op1_pii,
    "op2_langid": op2_langid,
    "op3_mainhtml": op3_mainhtml,
    "op4_topk": op4_topk,
    "op5_decontamination": op5_decontamination,
    "op6_suffixes": op6_suffixes,
    "op7_license": op7_license,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_lexical": op11_lexical,
    "op12_minhash": op12_minhash,
    "op13_codes": op13_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk": OP4_SQL,
    "op11_lexical": OP11_SQL,
    "op12_minhash": OP12_SQL,
    "op13_codes": _op13_sql(),
}
