"""Queries over sources, sinks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.extract import extract_fields
from claimspark.operators.results import latest_results, lookup_results, shape_results
from claimspark.plans.claims import process_events as run_events
from claimspark.plans.claims import judge, process_forms
from claimspark.plans.registry import query
from claimspark.plans.results_sql import LATEST, LATEST_ORDER
from claimspark.plans.views import table
from claimspark.session import fresh_path
from claimspark.sources import events, files, sinks
from claimspark.streaming.claims import stream_claims, upsert_stream


def land_as_files(docs: DataFrame, key: str, text: str, name: str) -> str:
    """Write one text file per row below the shared folder, named by the key."""
    path = fresh_path(docs.sparkSession, name)
    sinks.write_files(docs, path, key, text)
    return path


@query("""
SELECT document_id, CAST(strlen(document_text) AS BIGINT) AS n_bytes FROM pages_as_files ORDER BY document_id
""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = land_as_files(table(spark, sf_dir, "pages_as_files"), "document_id", "document_text", "pages")
    return files.list_documents(spark, path)


@query("""
SELECT document_id, 'text' AS media, document_text FROM pages_as_files
""")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = land_as_files(table(spark, sf_dir, "pages_as_files"), "document_id", "document_text", "pages")
    return files.scan_documents(spark, path).select("document_id", "media", "document_text")


@query("""
SELECT doc_id, file_name,
       CASE WHEN regexp_matches(lower(file_name), '\\.(png|jpg|jpeg)$')
            THEN CASE WHEN contains(lower(file_name), 'invoice') THEN 'invoice' ELSE 'photo' END
            ELSE 'text' END AS media
FROM upload_names
""")
def classify_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classify_media(table(spark, sf_dir, "upload_names"), "file_name")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fallback' ELSE 'primary' END AS origin, d.n_chars
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def source_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    primary = docs.join(labelled, "doc_id", "left_semi").withColumn("origin", F.lit("primary"))
    return files.source_with_fallback(primary, docs.withColumn("origin", F.lit("fallback")), "doc_id")


@query("""
SELECT doc_id, file_name, CASE WHEN reject_reason IS NULL THEN cleaned END AS document_id, reject_reason
FROM (SELECT doc_id, file_name, cleaned,
        CASE WHEN file_name = '' THEN 'Empty filename'
             WHEN NOT regexp_matches(file_name, '\\.(txt|png|jpg|jpeg)$') THEN 'File type not allowed'
             WHEN cleaned = '' THEN 'Unusable filename' END AS reject_reason
      FROM (SELECT doc_id, file_name, regexp_replace(regexp_replace(regexp_replace(replace(file_name, '/', ' '),
                     '\\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS cleaned
            FROM upload_names) a) b
""")
def admit_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.admit_uploads(table(spark, sf_dir, "upload_names"))


@query("SELECT file_name, text FROM policies")
def scan_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = land_as_files(table(spark, sf_dir, "policies"), "file_name", "text", "policies")
    return files.scan_policies(spark, path)


@query("""
SELECT file_name, CAST(pos AS INT) AS pos, chunk FROM (
  SELECT document_id AS file_name, row_number() OVER (PARTITION BY document_id ORDER BY n) - 1 AS pos, chunk
  FROM (SELECT document_id, n, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS chunk
        FROM (SELECT document_id, unnest(string_split(document_text, chr(10) || chr(10))) AS piece,
                     generate_subscripts(string_split(document_text, chr(10) || chr(10)), 1) AS n
              FROM claim_docs) a) b
  WHERE chunk <> '') c
""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.chunk_paragraphs(table(spark, sf_dir, "claim_docs"), "document_id", "document_text")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_results(table(spark, sf_dir, "results_log"), order=LATEST_ORDER)


def _plain(results: DataFrame) -> DataFrame:
    return results.withColumn("claim_amount", F.col("claim_amount").cast("double"))


@query(f"""
SELECT r.* FROM {LATEST} r
WHERE r.document_id IN (SELECT 'claim_' || lpad(CAST(event_id AS STRING), 12, '0') || '.txt' FROM events)
""")
def q_lookup_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(
        F.format_string("claim_%012d.txt", "event_id").alias("document_id")
    )
    return _plain(lookup_results(table(spark, sf_dir, "results_log"), keys, LATEST_ORDER))


@query(f"SELECT * FROM {LATEST} r")
def q_latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_latest(spark, sf_dir))


@query("""
SELECT event_id, CASE WHEN recs IS NOT NULL THEN json_extract_string(payload, '$.Records[0].s3.bucket.name')
                 ELSE json_extract_string(payload, '$.bucket') END AS bucket,
       key AS document_id, CASE WHEN key IS NULL THEN 'Missing document key in event' END AS run_error
FROM (SELECT event_id, payload, json_extract(payload, '$.Records') AS recs,
        nullif(CASE WHEN json_extract(payload, '$.Records') IS NOT NULL
               THEN json_extract_string(payload, '$.Records[0].s3.object.key')
               ELSE json_extract_string(payload, '$.key') END, '') AS key
      FROM upload_events) e
""")
def normalise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalise_events(table(spark, sf_dir, "upload_events")).drop("payload")


@query("""
SELECT event_id, json_extract_string(payload, '$.detail.bucket.name') AS bucket,
       json_extract_string(payload, '$.detail.object.key') AS key
FROM upload_events
WHERE json_extract_string(payload, '$.source') = 'aws.s3'
  AND json_extract_string(payload, '$."detail-type"') = 'Object Created'
  AND json_extract_string(payload, '$.detail.bucket.name') = 'inbox'
""")
def filter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.filter_events(table(spark, sf_dir, "upload_events"), bucket=["inbox"]).drop("payload")


@query("""
SELECT doc_id, file_name AS document_id, content, CASE WHEN regexp_matches(lower(file_name), '\\.(png|jpg|jpeg)$')
         THEN CASE WHEN contains(lower(file_name), 'invoice') THEN 'invoice' ELSE 'photo' END
         ELSE 'text' END AS media
FROM (SELECT u.doc_id, u.file_name, d.text AS content FROM upload_names u JOIN documents d USING (doc_id)) x
""")
def land_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "landing")
    content = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    docs = table(spark, sf_dir, "upload_names").withColumnRenamed("file_name", "document_id").join(content, "doc_id")
    sinks.land_documents(docs, path)
    return spark.read.parquet(path).select("doc_id", "document_id", "content", "media")


# Rows as the form reader stores them: what the sinks write, checked against plain SQL.
_FORM = """
(SELECT claim_no, document_id, claimant_name, policy_number, incident_date, claim_amount, incident_description,
        CASE substr(policy_number, 1, 5) WHEN 'AUTO-' THEN 'auto' WHEN 'PROP-' THEN 'property' WHEN 'HLTH-' THEN 'health'
             ELSE 'other' END AS claim_type
 FROM (SELECT claim_no, document_id,
        nullif(regexp_extract(document_text, '(?m)^Claimant Name:[ \\t]*(.*)$', 1), '') AS claimant_name,
        nullif(regexp_extract(document_text, '(?m)^Policy Number:[ \\t]*(.*)$', 1), '') AS policy_number,
        nullif(regexp_extract(document_text, '(?m)^Date of (Incident|Invoice):[ \\t]*(.*)$', 2), '') AS incident_date,
        TRY_CAST(regexp_extract(document_text, '(?m)^Claim Amount Requested:[ \\t]*(INR )?(.*)$', 2) AS DOUBLE) AS claim_amount,
        nullif(replace(regexp_extract(document_text, '(?s)Incident Description:\\n(.*?)\\n\\n', 1), chr(10), ' '), '')
          AS incident_description
       FROM claim_docs) f)
"""


@query(f"SELECT * EXCLUDE (claim_no) FROM {_FORM} f")
def q_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_fields(table(spark, sf_dir, "claim_docs")).drop("claim_no", "document_text")


_EMPTY = " || ".join(
    f"CASE WHEN {c} IS NULL THEN 'Field ''{c}'' is empty/null — document may lack this info;' ELSE '' END"
    for c in ("claimant_name", "policy_number", "incident_date", "claim_amount", "incident_description")
)


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_forms(table(spark, sf_dir, "claim_docs"), now=0)


def _flat(results: DataFrame) -> DataFrame:
    return results.select(
        "document_id",
        "status",
        F.col("extracted_info.claimant_name").alias("claimant_name"),
        F.col("extracted_info.policy_number").alias("policy_number"),
        F.col("extracted_info.incident_date").alias("incident_date"),
        F.col("extracted_info.claim_amount").cast("double").alias("claim_amount"),
        F.col("extracted_info.incident_description").alias("incident_description"),
        F.col("extracted_info.claim_type").alias("claim_type"),
        F.array_join(F.transform("validation_warnings", lambda w: F.concat(w, F.lit(";"))), "").alias("warnings"),
        F.array_join("injection_flags", "|").alias("flags"),
    )


_FLAT = f"""
SELECT f.document_id, '{{status}}' AS status, f.claimant_name, f.policy_number, f.incident_date, f.claim_amount,
       f.incident_description, f.claim_type, {_EMPTY} AS warnings,
       concat_ws('|', CASE WHEN contains(lower(document_text), 'ignore previous instructions') THEN 'ignore previous instructions' END,
         CASE WHEN contains(lower(document_text), 'ignore all prior') THEN 'ignore all prior' END,
         CASE WHEN contains(lower(document_text), 'system prompt') THEN 'system prompt' END,
         CASE WHEN contains(lower(document_text), 'you are now') THEN 'you are now' END) AS flags
FROM {_FORM} f JOIN claim_docs d ON f.document_id = d.document_id
"""


@query(_FLAT.format(status="success"))
def process_claim_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole form path: flags, fields, validation, routing, rules, summary, shaping."""
    return _flat(_processed(spark, sf_dir))


@query(_FLAT.format(status="success"))
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through Structured Streaming: landed files, upserted batches, latest row read."""
    landed, stored = fresh_path(spark, "inbox"), fresh_path(spark, "results")
    docs = table(spark, sf_dir, "claim_docs").select("document_id", "document_text")
    docs.write.parquet(landed)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(landed)
    upsert_stream(
        arriving, stored, fresh_path(spark, "stream-state"), lambda batch: process_forms(batch, now=0)
    ).awaitTermination()
    written = sinks.stored_results(spark, stored)
    return _flat(latest_results(written))


@query(f"SELECT * EXCLUDE (batch_id, summary) FROM {LATEST} r")
def stream_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results delivered again and again in several batches; the newest of each document is read."""
    landed, stored = fresh_path(spark, "deliveries"), fresh_path(spark, "results")
    log = table(spark, sf_dir, "results_log").withColumnRenamed("batch_id", "delivery")
    log.write.parquet(landed)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(landed)
    upsert_stream(arriving, stored, fresh_path(spark, "stream-state"), lambda batch: batch).awaitTermination()
    columns = ", ".join(f"{name} {kind}" for name, kind in log.dtypes)
    written = sinks.stored_results(spark, stored, columns)
    order = ("processed_timestamp", "delivery", "claim_amount", "status", "summary")
    return _plain(latest_results(written, order=order)).drop("run_id", "batch_id", "delivery", "summary")


@query("""
SELECT key AS document_id, CASE WHEN c.document_id IS NULL THEN 'pipeline_failure' ELSE 'success' END AS status,
       CASE WHEN c.document_id IS NULL THEN 'An unexpected pipeline execution error occurred' END AS error
FROM (SELECT DISTINCT nullif(CASE WHEN json_extract(payload, '$.Records') IS NOT NULL
        THEN json_extract_string(payload, '$.Records[0].s3.object.key') ELSE json_extract_string(payload, '$.key') END, '') AS key
      FROM upload_events) e LEFT JOIN claims c ON c.document_id = e.key
""")
def process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event to document to result: what arrives is read, what is missing leaves a failure row."""
    told = events.normalise_events(table(spark, sf_dir, "upload_events"))
    return run_events(told, table(spark, sf_dir, "claim_docs"), now=0).select("document_id", "status", "error")


@query("""
SELECT path AS document_id, CASE WHEN image THEN 'pipeline_failure' ELSE 'extraction_failed' END AS status FROM (
  SELECT document_id || CASE WHEN contains(document_id, '.md') THEN '.PNG' ELSE '' END AS path, contains(document_id, '.md') AS image
  FROM pages_as_files) p
""")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of any name arriving below a folder: each leaves one row, an image one that says why."""
    pages = table(spark, sf_dir, "pages_as_files")
    named = pages.withColumn("document_id", F.concat("document_id", F.when(F.contains("document_id", F.lit(".md")), ".PNG").otherwise("")))
    inbox = land_as_files(named, "document_id", "document_text", "arrivals")
    stored = fresh_path(spark, "results")

    def judged(batch: DataFrame) -> DataFrame:
        # pages are no claim forms: an answer that is no JSON stands for the model's
        return shape_results(judge(batch.withColumn("raw_output", F.lit("no form"))), 0)

    stream_claims(spark, inbox, stored, fresh_path(spark, "stream-state"), judged).awaitTermination()
    return latest_results(sinks.stored_results(spark, stored)).select("document_id", "status")
