"""Queries over retrieval and the fraud check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators import fraud, retrieve
from claimspark.operators.prompts import retrieval_query
from claimspark.plans.registry import query
from claimspark.plans.views import table
from claimspark.session import materialise
from claimspark.sources.files import chunk_paragraphs

# ---------------------------------------------------------------- vectors


@query("""
SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS vector_norm
FROM embeddings
""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = retrieve.vector_norms(table(spark, sf_dir, "embeddings"))
    return measured.select("vec_id", "label", F.round("vector_norm", 6).alias("vector_norm"))


def label_centroids(embeddings: DataFrame) -> DataFrame:
    """One query vector per label, the mean of its vectors: ``query_id, embedding``."""
    cells = embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    # one entry per dimension, so the list has a fixed length
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("embedding")
    )


@query("""
WITH means AS (
  SELECT label, dim, avg(CAST(x AS DOUBLE)) AS mean
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) c GROUP BY label, dim),
centroids AS (SELECT label, list(mean ORDER BY dim) AS q FROM means GROUP BY label),
scored AS (
  SELECT c.label AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.q) AS s
  FROM embeddings e CROSS JOIN centroids c)
SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS r FROM scored) t WHERE r <= 2
""")
def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    best = retrieve.similarity_topk(embeddings, materialise(label_centroids(embeddings), "queries"), order=["vec_id"])
    return best.withColumn("similarity", F.round("similarity", 6))


# ---------------------------------------------------------------- policy passages


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_paragraphs(table(spark, sf_dir, "policies"))


def _type_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval query per distinct claim type, however many claims there are."""
    types = table(spark, sf_dir, "claims").select("claim_type").distinct()
    return retrieval_query(types).withColumnRenamed("claim_type", "query_id")


_RANKED = """
(WITH queries AS (SELECT DISTINCT claim_type AS query_id, claim_type || ' claim coverage limits and exclusions' AS q FROM claims),
 qt AS (SELECT query_id, term, 1 + ln(count(*)) AS tf FROM
        (SELECT query_id, unnest(regexp_extract_all(lower(q), '[\\p{L}\\p{N}]+')) AS term FROM queries) a GROUP BY ALL),
 ct AS (SELECT file_name, pos, term, 1 + ln(count(*)) AS w FROM
        (SELECT file_name, pos, unnest(regexp_extract_all(lower(chunk), '[\\p{L}\\p{N}]+')) AS term FROM policy_chunks) b GROUP BY ALL),
 norms AS (SELECT file_name, pos, sqrt(sum(w * w)) AS norm FROM ct GROUP BY ALL),
 idf AS (SELECT term, ln(1 + (SELECT count(*) FROM norms)::DOUBLE / count(*)) AS idf FROM ct
         WHERE term IN (SELECT term FROM qt) GROUP BY term),
 qw AS (SELECT query_id, term, tf * idf AS w FROM qt JOIN idf USING (term)),
 qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id),
 scored AS (SELECT qw.query_id, ct.file_name, ct.pos, round(sum(ct.w * qw.w / (norms.norm * qn.norm)), 9) AS s
            FROM ct JOIN qw ON ct.term = qw.term JOIN norms ON ct.file_name = norms.file_name AND ct.pos = norms.pos
            JOIN qn ON qw.query_id = qn.query_id GROUP BY ALL)
 SELECT query_id, file_name, pos, round(s, 6) AS similarity, CAST(r AS INT) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, file_name, pos) AS r FROM scored) t WHERE r <= 2)
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.tfidf_retrieve(_chunks(spark, sf_dir), _type_queries(spark, sf_dir))


@query(f"SELECT * FROM {_RANKED} r")
def tfidf_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


_CONTEXTS = f"""
(SELECT r.query_id, string_agg(c.chunk, chr(10) || '---' || chr(10) ORDER BY r.rank) AS context
 FROM {_RANKED} r JOIN policy_chunks c ON r.file_name = c.file_name AND r.pos = c.pos GROUP BY r.query_id)
"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    topk = materialise(_ranked(spark, sf_dir), "ranked")
    return retrieve.policy_context(topk, chunks)


@query(f"SELECT * FROM {_CONTEXTS} x")
def policy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir)


@query(f"SELECT c.document_id, c.claim_type, x.context FROM claims c LEFT JOIN {_CONTEXTS} x ON c.claim_type = x.query_id")
def attach_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "claims").select("document_id", "claim_type")
    return retrieve.attach_context(claims, materialise(_contexts(spark, sf_dir), "contexts"))


@query("SELECT count(*) AS n_chunks, count(DISTINCT file_name) AS n_files FROM policy_chunks")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.chunk_stats(_chunks(spark, sf_dir))


# ---------------------------------------------------------------- fraud check

_HITS = """
(SELECT n.needle, d.document_id
 FROM (SELECT DISTINCT lower(claimant_name) AS needle FROM claims UNION SELECT DISTINCT lower(policy_number) FROM claims) n
 JOIN claim_docs d ON contains(lower(d.document_text), n.needle) WHERE n.needle <> '')
"""
_MATCHES = f"""
(SELECT i.kind, i.identifier, h.document_id
 FROM (SELECT DISTINCT 'claimant' AS kind, claimant_name AS identifier FROM claims
       UNION ALL SELECT DISTINCT 'policy', policy_number FROM claims) i
 JOIN {_HITS} h ON lower(i.identifier) = h.needle)
"""


def _fraud_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, fraud.FraudIndex]:
    claims = table(spark, sf_dir, "claims").select("document_id", "claimant_name", "policy_number")
    return claims, fraud.fraud_index(claims, table(spark, sf_dir, "claim_docs"))


@query(f"SELECT * FROM {_MATCHES} m")
def fraud_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.fraud_matches(*_fraud_inputs(spark, sf_dir))


@query(f"""
SELECT kind, identifier, document_id, CASE kind WHEN 'claimant' THEN 'Matching claimant ''' ELSE 'Matching policy number ''' END
       || identifier || ''' found in file ''' || document_id || '''' AS reason
FROM {_MATCHES} m
""")
def fraud_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.fraud_reasons(fraud.fraud_matches(*_fraud_inputs(spark, sf_dir)))


_SCORES = f"""
(WITH hits AS MATERIALIZED (SELECT * FROM {_HITS} h),
 totals AS (SELECT needle, count(*) AS n FROM hits GROUP BY needle)
 SELECT c.document_id, coalesce(a.n, 0) - CASE WHEN sa.needle IS NULL THEN 0 ELSE 1 END AS claimant_hits,
        coalesce(b.n, 0) - CASE WHEN sb.needle IS NULL THEN 0 ELSE 1 END AS policy_hits
 FROM claims c LEFT JOIN totals a ON a.needle = lower(c.claimant_name) LEFT JOIN totals b ON b.needle = lower(c.policy_number)
 LEFT JOIN hits sa ON sa.needle = lower(c.claimant_name) AND sa.document_id = c.document_id
 LEFT JOIN hits sb ON sb.needle = lower(c.policy_number) AND sb.document_id = c.document_id)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.fraud_score(*_fraud_inputs(spark, sf_dir))


@query(f"""
SELECT document_id, claimant_hits, policy_hits, CAST(least(100, 45 * claimant_hits + 50 * policy_hits) AS INT) AS risk_score
FROM {_SCORES} s
""")
def fraud_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(f"""
SELECT document_id, CASE WHEN score > 50 THEN 'High' WHEN score > 0 THEN 'Medium' ELSE 'Low' END AS risk_band,
       CAST(score AS STRING) || '% ' || CASE WHEN score > 50 THEN 'High' WHEN score > 0 THEN 'Medium' ELSE 'Low' END || ' Risk' AS risk_label
FROM (SELECT document_id, least(100, 45 * claimant_hits + 50 * policy_hits) AS score FROM {_SCORES} s) t
""")
def fraud_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.fraud_band(_scores(spark, sf_dir)).select("document_id", "risk_band", "risk_label")


# under review: claims whose order has a returned line item, a property of the claims' own tables over all keys
_REVIEWED = "(SELECT * FROM claims WHERE claim_no IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))"


@query(f"""
SELECT c.document_id, d.document_id AS other_id, 0 AS ord,
       'Matching claimant ''' || c.claimant_name || ''' found in file ''' || d.document_id || '''' AS reason
FROM {_REVIEWED} c JOIN claim_docs d ON d.document_id <> c.document_id AND contains(lower(d.document_text), lower(c.claimant_name))
WHERE c.claimant_name <> ''
UNION ALL
SELECT c.document_id, d.document_id, 1,
       'Matching policy number ''' || c.policy_number || ''' found in file ''' || d.document_id || ''''
FROM {_REVIEWED} c JOIN claim_docs d ON d.document_id <> c.document_id AND contains(lower(d.document_text), lower(c.policy_number))
WHERE c.policy_number <> ''
""")
def claim_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the claims under review (an order with a returned line item), in report order."""
    returned = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    reviewed = returned.select(F.col("l_orderkey").alias("claim_no")).distinct()
    under_review = table(spark, sf_dir, "claims").join(reviewed, "claim_no", "left_semi")
    claims = materialise(under_review.select("document_id", "claimant_name", "policy_number"), "reviewed")
    index = fraud.fraud_index(claims, table(spark, sf_dir, "claim_docs"))
    matches = materialise(fraud.fraud_matches(claims, index), "reviewed-matches")
    return fraud.reasons_for(claims, matches, in_order=True)
