"""The operators with production parameters over the whole given tables, and reference SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bm25, centroid_tree, dual_tree, exact_dedup, language_id, license_scan, line_templates, mixing, near_dedup, packing, quality, toxicity, warc_archive
from tallyloom.llm.common import LOWER, UPPER, crc_of_id, documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    docs = documents(spark, sf_dir)
    profiles = language_id.learn_profiles(docs.where(~held).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), profiles)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bm25.search(docs, docs.where("doc_id % 50 = 0"))


def quality_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(documents(spark, sf_dir))


def equal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("row", "first_row")


def documents_without_recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def licenses_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "detections")


def toxicity_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.learn(docs.select("doc_id", "text"), labels.where(~held).select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), scorer).drop("text")


def clusters_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_tree.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def codes_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def records_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_language_id": language_of_documents,
    "op2_best_fit_packing": packed_documents,
    "op3_source_mixing": mixed_documents,
    "op4_bm25_search": similar_documents,
    "op5_quality_classifier": quality_of_documents,
    "op6_exact_dedup": equal_documents,
    "op7_near_dedup": near_documents,
    "op8_line_dedup": documents_without_recurring_lines,
    "op9_license_scan": licenses_of_documents,
    "op10_toxicity": toxicity_of_documents,
    "op11_centroid_clustering": clusters_of_vectors,
    "op12_vector_compression": codes_of_vectors,
    "op13_warc": records_of_pages,
}

_WORDS = r"'[^\x20\x09-\x0D]+'"
_FOLDED = f"translate(text, '{UPPER}', '{LOWER}')"


def _clustering_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Rounds of clustering as common tables: e are components of centroids, a are assignments."""
    parts = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS place,
    [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings WHERE len(embedding) = {dim} AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
v AS MATERIALIZED (SELECT r, unnest(range({dim})) AS i, unnest(x) AS x FROM kept),
s AS (SELECT row_number() OVER (ORDER BY place, x) - 1 AS k, x FROM kept),
e0 AS (SELECT k, unnest(range({dim})) AS i, unnest(x) AS x FROM s WHERE k < {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, min(d * {k} + k) % {k} AS k, min(d) AS d
  FROM (SELECT r, k, sum((v.x - e{n}.x) * (v.x - e{n}.x))::BIGINT AS d FROM v JOIN e{n} USING (i) GROUP BY r, k) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
e{n + 1} AS MATERIALIZED (
  SELECT e{n}.k, e{n}.i, coalesce(m.x, e{n}.x) AS x
  FROM e{n} LEFT JOIN (SELECT k, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM a{n} JOIN v USING (r) GROUP BY k, i) m ON m.k = e{n}.k AND m.i = e{n}.i)""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM e{rounds} GROUP BY k) h ON h.k = a.k"""


def _compression_sql(parts: int = 16, n: int = 64, rounds: int = 2, dim: int = 64) -> str:
    """Rounds on codebooks as common tables: b are components of entries, a are assignments."""
    width = dim // parts
    out = [f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label,
    [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
u AS (SELECT r, unnest(range({dim})) AS j, unnest(x) AS x FROM kept WHERE len(x) = {dim}),
v AS MATERIALIZED (SELECT r, CAST(floor(j / {width}) AS BIGINT) AS p, j % {width} AS i, x FROM u),
b0 AS (SELECT r AS e, p, i, x FROM v WHERE r < {n})"""]
    for t in range(rounds + 1):
        out.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, p, min(d * {n} + e) % {n} AS e, min(d) AS d
  FROM (SELECT r, p, e, sum((v.x - b{t}.x) * (v.x - b{t}.x))::BIGINT AS d FROM v JOIN b{t} USING (p, i) GROUP BY r, p, e) GROUP BY r, p)""")
        if t < rounds:
            out.append(f"""
b{t + 1} AS MATERIALIZED (
  SELECT b.e, b.p, b.i, coalesce(m.x, b.x) AS x
  FROM b{t} b LEFT JOIN (SELECT e, p, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM a{t} JOIN v USING (r, p) GROUP BY e, p, i) m
    ON m.e = b.e AND m.p = b.p AND m.i = b.i)""")
    return ",".join(out) + f""",
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM kept LEFT JOIN c USING (r)"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n{part} >> {shift}) & 31 AS INTEGER) + 1, 1)" for part in range(4) for shift in range(35, -1, -5)
)
_TENS = ", ".join(f"CAST('0x' || substr(sha1(t), {10 * part + 1}, 10) AS BIGINT) AS n{part}" for part in range(4))

ORACLE = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_vector_compression": _compression_sql(),
    "op13_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first, {_TENS} FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op3_source_mixing": rf"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORDS})), 0) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS place
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM per),
r AS (
  SELECT *, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
    CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE) AS spent,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS weight_left
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - spent) / weight_left AS own FROM r),
t AS (
  SELECT source, source_size, CASE WHEN cap <= own * weight THEN CAST(cap AS DOUBLE)
    ELSE (max(CASE WHEN cap > own * weight THEN own END) OVER ()) * weight END AS target
  FROM l),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM t),
u AS (SELECT source, place, sum(size) AS words FROM s GROUP BY source, place),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT s.doc_id, s.size, p.source_size, p.target,
  CAST(s.size * (p.whole + CASE WHEN before + words <= target - whole * source_size
    OR (before <= target - whole * source_size AND target - whole * source_size - before > before + words - (target - whole * source_size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.place = s.place""",
    "op4_bm25_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, {_WORDS})) AS w FROM documents),
tf AS (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS tf FROM t GROUP BY doc_id, w),
dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM dl) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
sc AS (
  SELECT q.doc_id AS query_id, d.doc_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (d.tf * 2.2) / (d.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM tf q JOIN tf d ON d.w = q.w JOIN df ON df.w = q.w JOIN dl ON dl.doc_id = d.doc_id CROSS JOIN st
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10""",
    "op6_exact_dedup": r"""
WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM s WINDOW g AS (PARTITION BY t)""",
    "op7_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_FOLDED}, ''), {_WORDS}) AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS s
  FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS joint, count(*) AS common FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 75 * joint),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = s.doc_id""",
}
