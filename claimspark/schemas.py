"""DDL of the tables that flow between the operators."""

DOCUMENT = "document_id STRING, document_text STRING, media STRING"

POLICY = "file_name STRING, text STRING"

CHUNK = "file_name STRING, pos INT, chunk STRING"

CLAIM = (
    "claimant_name STRING, policy_number STRING, incident_date STRING, "
    "claim_amount DOUBLE, incident_description STRING, claim_type STRING"
)

REQUEST = "document_id STRING, model_id STRING, task STRING, system STRING, prompt STRING"

RESPONSE = (
    "document_id STRING, model_id STRING, task STRING, raw_output STRING, "
    "input_tokens BIGINT, output_tokens BIGINT, latency_seconds DOUBLE, error STRING"
)

METRICS = (
    "extraction_latency_s DOUBLE, summary_latency_s DOUBLE, "
    "extraction_model STRING, summary_model STRING"
)

STORED_CLAIM = (
    "claimant_name: STRING, policy_number: STRING, incident_date: STRING, "
    "claim_amount: DECIMAL(18,2), incident_description: STRING, claim_type: STRING"
)

# one wide nullable table; ``status`` says which columns are filled
RESULT = (
    "document_id STRING, status STRING, "
    f"extracted_info STRUCT<{STORED_CLAIM}>, "
    "validation_warnings ARRAY<STRING>, injection_flags ARRAY<STRING>, summary STRING, "
    "metrics STRUCT<extraction_latency_s: DOUBLE, summary_latency_s: DOUBLE, "
    "extraction_model: STRING, summary_model: STRING>, "
    "processed_timestamp BIGINT, errors STRING, raw_output STRING, error STRING"
)

EVENT = (
    "Records ARRAY<STRUCT<s3: STRUCT<bucket: STRUCT<name: STRING>, object: STRUCT<key: STRING>>>>, "
    "bucket STRING, key STRING"
)

BUS_EVENT = (
    "source STRING, `detail-type` STRING, "
    "detail STRUCT<bucket: STRUCT<name: STRING>, object: STRUCT<key: STRING>>"
)
