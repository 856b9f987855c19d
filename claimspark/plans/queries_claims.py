"""Queries over claims: text functions, prompts, validation, results, comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark import schemas
from claimspark.functions.text import format_inr, strip_code_fence
from claimspark.operators import compare, coverage, extract, prompts, results, validate
from claimspark.plans import claims as jobs
from claimspark.plans.registry import query
from claimspark.plans.results_sql import LATEST, LATEST_ORDER
from claimspark.plans.views import table
from claimspark.session import fresh_path
from claimspark.sources import sinks
from claimspark.streaming.claims import upsert_stream

SMALL, LARGE = "small", "large"

# ---------------------------------------------------------------- text and prompts


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_template(template: str, **values: str) -> str:
    """A fixed prompt text as an SQL expression, with column expressions at its marks."""
    sql = _sql_text(C.TEMPLATES[template][1])
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


_FLAGS = ", ".join(f"CASE WHEN contains(lower(document_text), '{m}') THEN '{m}' END" for m in C.INJECTION_MARKERS)


@query(f"SELECT doc_id, concat_ws('|', {_FLAGS}) AS flags FROM marked_documents")
def flag_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = extract.flag_injections(table(spark, sf_dir, "marked_documents"))
    return flagged.select("doc_id", F.array_join("injection_flags", "|").alias("flags"))


@query("""
SELECT conv_id, turn, concat_ws('|', CASE WHEN contains(lower(text), 'the') THEN 'the' END,
       CASE WHEN contains(lower(text), 'der') THEN 'der' END, CASE WHEN contains(lower(text), 'é') THEN 'É' END) AS flags
FROM conversations
""")
def flag_custom_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = extract.flag_injections(table(spark, sf_dir, "conversations"), "text", ["the", "der", "É"])
    return flagged.select("conv_id", "turn", F.array_join("injection_flags", "|").alias("flags"))


@query("SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT doc_id, substr(text, 1, 8000) AS t FROM documents) d")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = prompts.truncate_text(table(spark, sf_dir, "documents"), "text")
    return cut.select("doc_id", F.length("embed_text").cast("bigint").alias("n"), F.md5("embed_text").alias("digest"))


@query(f"""
SELECT document_id, 'small' AS model_id, md5({_sql_text(C.EXTRACT_SYSTEM)}) AS system_digest,
       md5({_sql_template('extract_info', document_text='document_text')}) AS prompt_digest
FROM claim_docs
""")
def render_extract_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = jobs.extraction_requests(table(spark, sf_dir, "claim_docs"), SMALL)
    return asked.select(
        "document_id", "model_id", F.md5("system").alias("system_digest"), F.md5("prompt").alias("prompt_digest")
    )


@query(f"""
SELECT document_id, {_sql_template('generate_summary', extracted_info='info', policy_context='claim_type')} AS prompt
FROM (SELECT document_id, claim_type, '{{"claimant_name":"' || claimant_name || '","policy_number":"' || policy_number
        || '","incident_date":"' || incident_date || '"}}' AS info FROM claims) c
""")
def render_summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "claims")
    info = F.to_json(F.struct("claimant_name", "policy_number", "incident_date"))
    asked = prompts.render_prompt(
        claims, "generate_summary", {"extracted_info": info, "policy_context": F.col("claim_type")}
    )
    return asked.select("document_id", "prompt")


@query("SELECT document_id, model_id, CAST(ceil(length(raw_output) / 4.0) AS BIGINT) AS input_tokens FROM model_outputs")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = prompts.estimate_tokens(table(spark, sf_dir, "model_outputs"), "raw_output")
    return sized.select("document_id", "model_id", "input_tokens")


@query("""
SELECT document_id, model_id, round(input_tokens / 1000.0 * CASE model_id WHEN 'small' THEN 0.00025 ELSE 0.003 END
       + output_tokens / 1000.0 * CASE model_id WHEN 'small' THEN 0.00125 ELSE 0.015 END, 9)::DOUBLE AS cost_usd
FROM responses
""")
def estimate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = prompts.estimate_cost(table(spark, sf_dir, "responses"))
    return priced.select("document_id", "model_id", F.round("cost_usd", 9).alias("cost_usd"))


def _length_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A model call as a user would supply it; it answers with the size of the prompt."""
    for batch in batches:
        size = batch["prompt"].str.len()
        yield pd.DataFrame(
            {
                "raw_output": '{"chars": ' + size.astype(str) + "}",
                "input_tokens": size // 4,
                "output_tokens": 5,
                "latency_seconds": 0.5,
            }
        )


@query(f"""
SELECT document_id, 'small' AS model_id, 'extract_info' AS task, '{{"chars": ' || CAST(n AS STRING) || '}}' AS raw_output,
       CAST(n // 4 AS BIGINT) AS input_tokens, CAST(5 AS BIGINT) AS output_tokens, CAST(0.5 AS DOUBLE) AS latency_seconds,
       CAST(NULL AS STRING) AS error
FROM (SELECT document_id, length({_sql_template('extract_info', document_text='document_text')}) AS n FROM claim_docs) d
""")
def infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.infer(jobs.extraction_requests(table(spark, sf_dir, "claim_docs"), SMALL), _length_model)


@query("SELECT document_id, claim_type || ' claim coverage limits and exclusions' AS query_text FROM claims")
def retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.retrieval_query(table(spark, sf_dir, "claims")).select("document_id", "query_text")


@query("""
SELECT document_id, CASE substr(policy_number, 1, 5) WHEN 'AUTO-' THEN 'auto' WHEN 'PROP-' THEN 'property'
       WHEN 'HLTH-' THEN 'health' ELSE 'other' END AS claim_type
FROM claims
""")
def classify_claim_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = extract.classify_claim_type(table(spark, sf_dir, "claims").drop("claim_type"))
    return typed.select("document_id", "claim_type")


def _grouped(amount: str) -> str:
    """Indian digit grouping in SQL: the last three digits, then pairs, cut from the right."""
    whole = f"CAST(CAST(trunc({amount}) AS BIGINT) AS STRING)"
    cents = f"rtrim(rtrim(right(CAST({amount} AS STRING), 3), '0'), '.')"
    head = f"left({whole}, greatest(length({whole}) - 3, 0))"
    pairs = (
        f"CASE WHEN length({head}) = 0 THEN '' WHEN length({head}) <= 2 THEN {head} || ',' "
        f"WHEN length({head}) <= 4 THEN left({head}, length({head}) - 2) || ',' || right({head}, 2) || ',' "
        f"ELSE left({head}, length({head}) - 4) || ',' || substr({head}, length({head}) - 3, 2) || ',' || right({head}, 2) || ',' END"
    )
    return f"({pairs} || right({whole}, 3) || {cents})"


@query(f"SELECT document_id, {_grouped('claim_amount')} AS amount_inr FROM claims")
def q_format_inr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").select("document_id", format_inr(F.col("claim_amount")).alias("amount_inr"))


_RULES = {
    "AUTO_SCRUTINY": ("claim_type = 'auto' AND claim_amount >= 200000", "own damage needs additional scrutiny"),
    "AUTO_POLICE_REPORT": ("claim_type = 'auto' AND claim_amount > 50000", "police report required"),
    "AUTO_LATE_FILING": ("claim_type = 'auto' AND delay > 30", "delay justification note required"),
    "PROP_OVER_CAP": ("claim_type = 'property' AND claim_amount > 500000", "above the per-incident cap"),
    "PROP_VERIFICATION": ("claim_type = 'property' AND claim_amount > 100000", "independent verification required"),
    "HLTH_DOCUMENTS": ("claim_type = 'health' AND claim_amount >= 0", "discharge summary and itemized bill required"),
}


def _fired(what: int, separator: str, skip: str = "") -> str:
    cases = [
        f"CASE WHEN {test} THEN '{(code, note)[what]}' END" for code, (test, note) in _RULES.items() if code != skip
    ]
    return f"concat_ws('{separator}', {', '.join(cases)})"


# a claim counts as filed on the day its first item shipped
_FILED = """
(SELECT c.*, CAST(f.filed AS DATE) - CAST(c.incident_date AS DATE) AS delay FROM claims c
 LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS filed FROM lineitem GROUP BY l_orderkey) f ON c.claim_no = f.l_orderkey)
"""


@query(f"SELECT document_id, {_fired(0, '|')} AS codes, {_fired(1, '; ')} AS notes FROM {_FILED} c")
def evaluate_coverage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("filed"))
    claims = table(spark, sf_dir, "claims")
    judged = coverage.evaluate_coverage_rules(
        claims.join(filed, claims["claim_no"] == filed["l_orderkey"], "left"), filed_date="filed"
    )
    return judged.select(
        "document_id", F.array_join("rule_codes", "|").alias("codes"), F.array_join("rule_notes", "; ").alias("notes")
    )


def _policy_case(column: int) -> str:
    def value(entry: tuple[str, list[str]]) -> str:
        return _sql_text(entry[0] if column == 0 else "|".join(entry[1]))

    whens = " ".join(f"WHEN '{kind}' THEN {value(entry)}" for kind, entry in C.POLICY_RULES.items())
    return f"CASE claim_type {whens} ELSE {value(C.UNCATEGORISED)} END"


@query(f"SELECT document_id, {_policy_case(0)} AS policy_title, {_policy_case(1)} AS rules FROM claims")
def lookup_policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = coverage.lookup_policy_rules(table(spark, sf_dir, "claims"))
    return titled.select("document_id", "policy_title", F.array_join("policy_rules", "|").alias("rules"))


@query(f"""
SELECT document_id, claimant_name || ' claims INR ' || {_grouped('claim_amount')} || ' for an incident on ' || incident_date
       || '. ' || incident_description || ' Policy: ' || {_policy_case(0)} || '. '
       || CASE WHEN notes = '' THEN 'No coverage rule needs a manual check.' ELSE 'Check: ' || notes || '.' END AS summary
FROM (SELECT *, {_fired(1, '; ', 'AUTO_LATE_FILING')} AS notes FROM claims) c
""")
def summarise_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = coverage.evaluate_coverage_rules(coverage.lookup_policy_rules(table(spark, sf_dir, "claims")))
    return coverage.summarise_claims(ruled).select("document_id", "summary")


@query("""
SELECT document_id, array_to_string(list_sort(list_filter(list_distinct(said), lambda x: NOT list_contains(known, x))), '|') AS ungrounded,
       len(list_filter(said, lambda x: NOT list_contains(known, x))) = 0 AS is_grounded
FROM (SELECT s.document_id,
        list_transform(regexp_extract_all(s.raw_output, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', '')) AS said,
        list_transform(regexp_extract_all(d.document_text, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', '')) AS known
      FROM summaries s JOIN claim_docs d ON s.document_id = d.document_id) g
""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "summaries").select("document_id", F.col("raw_output").alias("summary"))
    checked = coverage.grounding_check(
        said.join(table(spark, sf_dir, "claim_docs"), "document_id"), "summary", ["document_text"]
    )
    return checked.select("document_id", F.array_join(F.array_sort("ungrounded"), "|").alias("ungrounded"), "is_grounded")


# ---------------------------------------------------------------- validation

_CLEANED = """
(SELECT *, CASE WHEN json_valid(cleaned) AND json_type(CASE WHEN json_valid(cleaned) THEN cleaned END) = 'OBJECT'
           THEN cleaned END AS j
 FROM (SELECT *, CASE WHEN starts_with(bare, '```')
         THEN regexp_replace(regexp_replace(bare, '(?m)^```(json)?|```$', '', 'g'), '^\\s+|\\s+$', '', 'g') ELSE bare END AS cleaned
       FROM (SELECT *, regexp_replace(raw_output, '^\\s+|\\s+$', '', 'g') AS bare FROM {source}) a) b)
"""


def _cleaned(source: str = "model_outputs") -> str:
    return _CLEANED.format(source=source)


def _present(f: str) -> str:
    return f"(json_type(j, '$.{f}') IS NOT NULL)"


def _value(f: str) -> str:
    return f"json_extract_string(j, '$.{f}')"


_MISSING = [f"CASE WHEN j IS NOT NULL AND NOT {_present(f)} THEN 'Missing required field: {f}' END" for f in C.REQUIRED_FIELDS]
_HOLLOW = [
    f"CASE WHEN {_present(f)} AND coalesce({_value(f)}, '') IN ('', 'null') "
    f"THEN 'Field ''{f}'' is empty/null — document may lack this info' END"
    for f in C.REQUIRED_FIELDS
]
_RAW = _value("claim_amount")
_NUM = f"TRY_CAST({_RAW} AS DOUBLE)"
_AMOUNT_ERRORS = [
    f"CASE WHEN {_RAW} IS NOT NULL AND {_NUM} IS NULL THEN 'claim_amount is not numeric: ' || "
    f"CASE WHEN starts_with({_RAW}, '[') THEN {_RAW} ELSE '''' || {_RAW} || '''' END END",
    f"CASE WHEN {_NUM} < 0 THEN 'claim_amount is negative' END",
]
_AMOUNT_WARNINGS = [f"CASE WHEN {_NUM} > 10000000 THEN 'claim_amount is unusually large — verify manually' END"]
_ERRORS = (
    f"CASE WHEN j IS NULL THEN 'Model did not return valid JSON: not a JSON object' "
    f"ELSE concat_ws(' | ', {', '.join(_MISSING + _AMOUNT_ERRORS)}) END"
)
_WARNINGS = f"concat_ws(' | ', {', '.join(_HOLLOW + _AMOUNT_WARNINGS)})"
_FIELDS = ", ".join(
    f"{_NUM} AS claim_amount" if f == "claim_amount" else f"{_value(f)} AS {f}" for f in C.REQUIRED_FIELDS
)


def _validated(source: str = "model_outputs") -> str:
    """Answers with errors, warnings, verdict and fields, in SQL."""
    return (
        f"(SELECT *, e = '' AS is_valid, CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' | ')) END AS n_warnings "
        f"FROM (SELECT * EXCLUDE (bare, cleaned, j), j IS NOT NULL AS is_object, {_ERRORS} AS e, "
        f"{_WARNINGS} AS w, {_FIELDS} FROM {_cleaned(source)} c) v)"
    )


@query(f"SELECT document_id, model_id, cleaned FROM {_cleaned()} c")
def q_strip_code_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "model_outputs").select(
        "document_id", "model_id", strip_code_fence(F.col("raw_output")).alias("cleaned")
    )


@query(f"""
SELECT document_id, model_id, j IS NOT NULL AS is_object,
       {', '.join(f"coalesce({_present(f)}, FALSE) AND j IS NOT NULL AS {f}_present, {_value(f)} AS {f}_value" for f in C.REQUIRED_FIELDS)}
FROM {_cleaned()} c
""")
def parse_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = validate.parse_extraction(table(spark, sf_dir, "model_outputs"))
    return read.drop("claim_no", "task", "raw_output", "cleaned", "input_tokens", "output_tokens", "latency_seconds")


@query(f"""
SELECT document_id, model_id, concat_ws(' | ', {', '.join(_MISSING)}) AS missing, concat_ws(' | ', {', '.join(_HOLLOW)}) AS hollow
FROM {_cleaned()} c
""")
def check_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.check_required_fields(validate.parse_extraction(table(spark, sf_dir, "model_outputs")))
    return checked.select(
        "document_id",
        "model_id",
        F.array_join("missing_errors", " | ").alias("missing"),
        F.array_join("empty_warnings", " | ").alias("hollow"),
    )


@query(f"""
SELECT document_id, model_id, {_NUM} AS amount, concat_ws(' | ', {', '.join(_AMOUNT_ERRORS)}) AS errors,
       concat_ws(' | ', {', '.join(_AMOUNT_WARNINGS)}) AS warnings
FROM {_cleaned()} c
""")
def check_claim_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.check_claim_amount(validate.parse_extraction(table(spark, sf_dir, "model_outputs")))
    return checked.select(
        "document_id",
        "model_id",
        "amount",
        F.array_join("amount_errors", " | ").alias("errors"),
        F.array_join("amount_warnings", " | ").alias("warnings"),
    )


@query(f"""
SELECT document_id, model_id, e AS errors, w AS warnings, is_valid, claimant_name, claim_amount, claim_type FROM {_validated()} v
""")
def validate_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate_extractions(table(spark, sf_dir, "model_outputs"))
    return checked.select(
        "document_id",
        "model_id",
        F.array_join("errors", " | ").alias("errors"),
        F.array_join("warnings", " | ").alias("warnings"),
        "is_valid",
        "parsed.claimant_name",
        "parsed.claim_amount",
        "parsed.claim_type",
    )


# ---------------------------------------------------------------- requests, answers, routing

_JOINED = """
(SELECT d.document_id, d.document_text, r.model_id AS answered_by, r.raw_output, r.input_tokens, r.output_tokens, r.latency_seconds
 FROM claim_docs d LEFT JOIN (SELECT * FROM responses WHERE model_id = 'small') r ON d.document_id = r.document_id)
"""
_JUDGED = f"""
(SELECT *, CASE WHEN answered_by IS NULL THEN 'pipeline_failure' WHEN is_valid THEN 'success' ELSE 'extraction_failed' END AS status
 FROM {_validated(_JOINED + ' x')} v)
"""


@query("""
SELECT q.document_id, q.model_id, q.task, r.raw_output, r.input_tokens, r.output_tokens, r.latency_seconds,
       CASE WHEN r.raw_output IS NULL THEN 'An unexpected pipeline execution error occurred' END AS run_error
FROM model_outputs q LEFT JOIN responses r
  ON q.document_id = r.document_id AND q.model_id = r.model_id AND q.task = r.task
""")
def join_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "model_outputs").select("document_id", "model_id", "task")
    return prompts.join_responses(asked, table(spark, sf_dir, "responses"))


@query("""
SELECT document_id, m.model_id, 'extract_info' AS task FROM claims CROSS JOIN (VALUES ('small'), ('large')) m(model_id)
""")
def compare_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_requests(table(spark, sf_dir, "claims"), [SMALL, LARGE])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.judged_claims(table(spark, sf_dir, "claim_docs"), table(spark, sf_dir, "responses"), SMALL)


@query(f"SELECT document_id, status, CASE WHEN status = 'extraction_failed' THEN e END AS errors FROM {_JUDGED} j")
def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.when(F.col("status") == C.STATUS_INVALID, F.array_join("errors", " | "))
    return _judged(spark, sf_dir).select("document_id", "status", errors.alias("errors"))


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.finish_claims(_judged(spark, sf_dir), table(spark, sf_dir, "summaries"), LARGE, now=1_700_000_000)


_SHAPED = f"""
(SELECT j.document_id, j.status, j.claimant_name, j.policy_number, CAST(j.claim_amount AS DOUBLE) AS claim_amount, j.claim_type,
        j.w AS warnings, concat_ws('|', {_FLAGS}) AS flags, s.raw_output AS summary, j.latency_seconds AS extraction_latency_s,
        s.latency_seconds AS summary_latency_s, j.e AS errors, j.raw_output,
        CAST(1700000000 AS BIGINT) AS processed_timestamp
 FROM {_JUDGED} j LEFT JOIN summaries s ON j.document_id = s.document_id)
"""


def _success_columns(rows: DataFrame, *more: str) -> DataFrame:
    info = F.col("extracted_info")
    return rows.select(
        "document_id",
        "status",
        info["claimant_name"].alias("claimant_name"),
        info["policy_number"].alias("policy_number"),
        info["claim_amount"].cast("double").alias("claim_amount"),
        info["claim_type"].alias("claim_type"),
        F.array_join("validation_warnings", " | ").alias("warnings"),
        F.array_join("injection_flags", "|").alias("flags"),
        "summary",
        F.col("metrics.extraction_latency_s").alias("extraction_latency_s"),
        F.col("metrics.summary_latency_s").alias("summary_latency_s"),
        "processed_timestamp",
        *more,
    )


_SUCCESS = (
    "document_id, status, claimant_name, policy_number, claim_amount, claim_type, warnings, flags, summary, "
    "extraction_latency_s, summary_latency_s, processed_timestamp"
)
_NULLED = ", ".join(
    f"CASE WHEN status = 'success' THEN {c} END AS {c}"
    for c in "claimant_name policy_number claim_amount claim_type warnings flags summary extraction_latency_s summary_latency_s".split()
)


@query(f"""
SELECT document_id, status, {_NULLED}, processed_timestamp,
       CASE WHEN status = 'extraction_failed' THEN '["' || replace(errors, ' | ', '","') || '"]' END AS errors,
       CASE WHEN status = 'extraction_failed' THEN raw_output END AS raw_output,
       CASE WHEN status = 'pipeline_failure' THEN 'An unexpected pipeline execution error occurred' END AS error
FROM {_SHAPED} s
""")
def shape_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _success_columns(_shaped(spark, sf_dir), "errors", "raw_output", "error")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All result rows after a round trip through the stored table."""
    path = fresh_path(spark, "results")
    sinks.write_results(_shaped(spark, sf_dir), path, batch_id=0)
    return sinks.stored_results(spark, path)


@query(f"SELECT {_SUCCESS} FROM {_SHAPED} s WHERE status = 'success'")
def sink_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _success_columns(sinks.success_rows(_written(spark, sf_dir)))


@query(f"""
SELECT document_id, status, '["' || replace(errors, ' | ', '","') || '"]' AS errors, raw_output
FROM {_SHAPED} s WHERE status = 'extraction_failed'
""")
def sink_extraction_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.invalid_rows(_written(spark, sf_dir))


@query(f"""
SELECT document_id, status, 'An unexpected pipeline execution error occurred' AS error FROM {_SHAPED} s WHERE status = 'pipeline_failure'
""")
def sink_run_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.failed_rows(_written(spark, sf_dir))


@query(f"""
SELECT document_id, status, CASE WHEN status = 'success' THEN claimant_name END AS claimant_name,
       CASE WHEN status = 'success' THEN summary END AS summary
FROM {_SHAPED} s
""")
def export_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "results-json")
    sinks.export_results_json(_shaped(spark, sf_dir), path)
    back = spark.read.schema(schemas.RESULT).json(path)
    return back.select("document_id", "status", F.col("extracted_info.claimant_name").alias("claimant_name"), "summary")


@query(f"""
SELECT document_id, status, CASE WHEN status = 'success' THEN claim_amount END AS claim_amount,
       CASE WHEN status = 'success' THEN coalesce(summary, '') ELSE '' END AS summary,
       CASE WHEN status = 'success' THEN warnings ELSE '' END AS warnings,
       CASE WHEN status = 'success' THEN flags ELSE '' END AS flags, processed_timestamp
FROM {_SHAPED} s
""")
def read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = results.read_results(_shaped(spark, sf_dir))
    return back.select(
        "document_id",
        "status",
        F.col("extracted_info.claim_amount").alias("claim_amount"),
        "summary",
        F.array_join("validation_warnings", " | ").alias("warnings"),
        F.array_join("injection_flags", "|").alias("flags"),
        "processed_timestamp",
    )


@query(f"SELECT status, count(*) AS n FROM {_JUDGED} j GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.status_counts(_judged(spark, sf_dir))


@query(f"""
SELECT CASE WHEN status = 'success' THEN claim_type END AS claim_type, status, count(*) AS n
FROM {_JUDGED} j GROUP BY ROLLUP (CASE WHEN status = 'success' THEN claim_type END, status)
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("status") == C.STATUS_OK, F.col("parsed.claim_type"))
    return compare.status_counts(_judged(spark, sf_dir).withColumn("claim_type", kind), by_type=True)


@query(f"SELECT status, count(*) AS n FROM {_JUDGED} j GROUP BY status")
def stream_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arriving as a stream, judged against stored answers, routed to the status folders."""
    landed, stored = fresh_path(spark, "inbox"), fresh_path(spark, "results")
    docs = table(spark, sf_dir, "claim_docs").select("document_id", "document_text")
    docs.write.parquet(landed)
    answers = table(spark, sf_dir, "responses")
    upsert_stream(
        spark.readStream.schema(docs.schema).parquet(landed),
        stored,
        fresh_path(spark, "stream-state"),
        lambda batch: results.shape_results(jobs.judged_claims(batch, answers, SMALL), now=0),
    ).awaitTermination()
    return compare.status_counts(sinks.stored_results(spark, stored))


_METRICS = """
(SELECT document_id, claim_type, latency_seconds AS x, CAST(210 + claim_no % 61 AS DOUBLE) / 100.0 AS y
 FROM (SELECT c.document_id, c.claim_type, c.claim_no, r.latency_seconds FROM claims c
       JOIN (SELECT document_id, latency_seconds FROM responses WHERE model_id = 'small') r ON c.document_id = r.document_id) m)
"""


@query(f"""
SELECT document_id, round(x + y, 2) AS total_latency_s,
       CAST(CASE WHEN claim_type = 'auto' THEN 0.00048 ELSE 0.0005 END AS DOUBLE) AS cost_per_claim_usd
FROM {_METRICS} m
""")
def claim_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "responses").where(F.col("model_id") == SMALL).select(
        "document_id", F.col("latency_seconds").alias("extraction_latency_s")
    )
    second = table(spark, sf_dir, "summaries").select(
        "document_id", F.col("latency_seconds").alias("summary_latency_s")
    )
    timed = table(spark, sf_dir, "claims").join(first, "document_id").join(second, "document_id")
    priced = results.claim_metrics(timed, {"auto": 0.00048}, other=0.0005)
    return priced.select("document_id", "total_latency_s", "cost_per_claim_usd")


@query(f"""
SELECT document_id, coalesce(claimant_name, '') AS claimant_name, coalesce(claim_amount, 0) AS claim_amount,
       coalesce(nullif(claim_type, ''), 'auto') AS claim_type
FROM {_JUDGED} j
""")
def default_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = results.default_fields(_judged(spark, sf_dir).select("document_id", "parsed.*"))
    return filled.select("document_id", "claimant_name", "claim_amount", "claim_type")


_KEYED = "(SELECT DISTINCT document_id FROM results_log)"


@query(f"""
SELECT c.document_id, CASE WHEN r.document_id IS NULL THEN 'Unprocessed' ELSE 'Processed' END AS badge,
       upper(replace(replace(c.document_id, '.txt', ''), 'claim_', '')) AS code, 'Doc' AS icon_type
FROM claims c LEFT JOIN {_KEYED} r ON c.document_id = r.document_id
""")
def claim_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.claim_listing(table(spark, sf_dir, "claims"), table(spark, sf_dir, "results_log"))


@query(f"""
SELECT c.document_id, coalesce(r.status, 'success') AS status, r.claim_amount AS stored_amount, r.summary AS stored_summary,
       CASE WHEN r.document_id IS NULL THEN 'computed' ELSE 'stored' END AS source
FROM claims c LEFT JOIN {LATEST} r ON c.document_id = r.document_id
""")
def stored_or_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "results_log").select(
        "document_id", "status", "processed_timestamp", "batch_id", "claim_amount", "summary"
    )
    docs = table(spark, sf_dir, "claim_docs")

    def compute(missing: DataFrame) -> DataFrame:
        return jobs.process_forms(missing, now=0).select("document_id", "status")

    merged = results.stored_or_computed(docs, log, compute, LATEST_ORDER)
    return merged.select(
        "document_id", "status", F.col("claim_amount").cast("double").alias("stored_amount"),
        F.col("summary").alias("stored_summary"), "source",
    )


# ---------------------------------------------------------------- model comparison

_CMP = f"""
(SELECT document_id, model_id AS model, latency_seconds AS latency_s, input_tokens, output_tokens,
        coalesce(is_valid AND answered, FALSE) AS valid_json, CASE WHEN answered THEN n_warnings ELSE 0 END AS warnings,
        coalesce(json_valid(raw_output) AND first_type = 'OBJECT', FALSE) AS first_try_json,
        coalesce(is_valid AND answered AND NOT contains(w, 'is empty/null'), FALSE) AS all_fields
 FROM (SELECT *, raw_output IS NOT NULL AS answered, json_type(CASE WHEN json_valid(raw_output) THEN raw_output END) AS first_type
       FROM {_validated("(SELECT q.document_id, q.model_id, r.raw_output, r.input_tokens, r.output_tokens, r.latency_seconds FROM model_outputs q LEFT JOIN responses r ON q.document_id = r.document_id AND q.model_id = r.model_id) x")} v) u)
"""


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = compare.compare_requests(table(spark, sf_dir, "claims"), [SMALL, LARGE])
    return compare.compare_models(asked, table(spark, sf_dir, "responses"))


@query(f"""
SELECT document_id, model, latency_s, input_tokens, output_tokens, valid_json, CAST(warnings AS BIGINT) AS warnings,
       first_try_json, all_fields
FROM {_CMP} c
""")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _comparison(spark, sf_dir).withColumn("warnings", F.col("warnings").cast("bigint"))
    flags = {f: F.coalesce(f, F.lit(False)) for f in ("valid_json", "first_try_json", "all_fields")}
    return rows.withColumns(flags)


_SUMMARY = """
(SELECT model, count(*) AS documents, avg(latency_s) AS avg_latency_s, avg(input_tokens) AS i, avg(output_tokens) AS o
 FROM {cmp} c GROUP BY model)
""".format(cmp=_CMP)
_COST = """(i / 1000.0 * CASE model WHEN 'small' THEN 0.00025 ELSE 0.003 END
            + o / 1000.0 * CASE model WHEN 'small' THEN 0.00125 ELSE 0.015 END) * 1000"""


@query(f"""
SELECT model, documents, round(avg_latency_s, 6) AS avg_latency_s, round(i, 6) AS avg_input_tokens, round(o, 6) AS avg_output_tokens,
       round(CAST({_COST} AS DOUBLE), 6) AS cost_per_1000_usd
FROM {_SUMMARY} s
""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = compare.model_summary(_comparison(spark, sf_dir))
    rounded = ("avg_latency_s", "avg_input_tokens", "avg_output_tokens", "cost_per_1000_usd")
    return summary.withColumns({c: F.round(c, 6) for c in rounded})


_SHARES = """
(SELECT model, count(*) AS documents, avg(CAST(valid_json AS INT)) AS valid_share, avg(CAST(all_fields AS INT)) AS all_fields_share,
        avg(CAST(first_try_json AS INT)) AS first_try_share
 FROM {cmp} c GROUP BY model)
""".format(cmp=_CMP)


@query(f"""
SELECT model, documents, round(valid_share, 9) AS valid_share, round(all_fields_share, 9) AS all_fields_share,
       round(first_try_share, 9) AS first_try_share
FROM {_SHARES} s
""")
def extraction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = compare.extraction_accuracy(_comparison(spark, sf_dir))
    return shares.withColumns({c: F.round(c, 9) for c in ("valid_share", "all_fields_share", "first_try_share")})


@query(f"""
SELECT s.model, round(a.valid_share, 9) AS valid_share, round(CAST({_COST.replace('model', 's.model')} AS DOUBLE), 6) AS cost_per_1000_usd
FROM {_SUMMARY} s JOIN {_SHARES} a ON s.model = a.model
ORDER BY a.valid_share DESC, 3, s.model LIMIT 1
""")
def pick_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _comparison(spark, sf_dir)
    picked = compare.pick_model(compare.model_summary(rows, valid_share=True))
    return picked.select(
        "model", F.round("valid_share", 9).alias("valid_share"), F.round("cost_per_1000_usd", 6).alias("cost_per_1000_usd")
    )
