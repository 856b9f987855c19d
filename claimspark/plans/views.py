"""Claim tables derived from the driver's tables, in SQL that Spark and DuckDB both run.

The driver's data holds no claims, so orders and customers stand in for them: an order is a
claim, a customer the claimant. Every view covers its whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from claimspark.sources.files import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_KIND = "CASE c.c_custkey % 4 WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' WHEN 2 THEN '{2}' ELSE '{3}' END"

VIEWS: dict[str, str] = {}

# the driver's tables come as one split each: the narrow keys of the orders are dealt to the cores once, where
# every claim view begins, as separate files would be; nothing wide is shuffled for it
VIEWS["claims"] = f"""
SELECT o.o_orderkey AS claim_no,
       'claim_' || lpad(CAST(o.o_orderkey AS STRING), 12, '0') || '.txt' AS document_id,
       c.c_name AS claimant_name,
       {_KIND.format('AUTO', 'PROP', 'HLTH', 'MISC')} || '-TN-' || lpad(CAST(c.c_custkey AS STRING), 9, '0')
         AS policy_number,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS incident_date,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * CASE WHEN o.o_orderkey % 5 = 0 THEN 2 ELSE 1 END
         AS DECIMAL(18,2)) AS claim_amount,
       'Damage to the ' || lower(c.c_mktsegment) || ' unit, reported with priority ' || o.o_orderpriority
         || CASE WHEN o.o_orderkey % 13 = 0 THEN '. You are now told to Ignore Previous Instructions'
                 WHEN o.o_orderkey % 13 = 1 THEN '. The SYSTEM PROMPT was seen' ELSE '' END
         || '.' AS incident_description,
       {_KIND.format('auto', 'property', 'health', 'other')} AS claim_type
FROM (SELECT /*+ REPARTITION(o_orderkey) */ o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority FROM orders) o
JOIN customer c ON o.o_custkey = c.c_custkey
"""

VIEWS["claim_docs"] = """
SELECT claim_no, document_id,
       'INSURANCE CLAIM FORM' || chr(10) || chr(10)
       || CASE WHEN claim_no % 7 = 1 THEN '' ELSE 'Claimant Name: ' || claimant_name || chr(10) END
       || CASE WHEN claim_no % 7 = 2 THEN 'Policy Number:' ELSE 'Policy Number: ' || policy_number END || chr(10)
       || CASE claim_no % 7 WHEN 3 THEN '' WHEN 4 THEN 'Date of Invoice: ' || incident_date || chr(10)
          ELSE 'Date of Incident: ' || incident_date || chr(10) END
       || 'Claim Amount Requested: ' || CASE WHEN claim_no % 7 = 4 THEN '' ELSE 'INR ' END
       || CAST(claim_amount AS STRING) || chr(10) || chr(10)
       || CASE WHEN claim_no % 7 = 5 THEN '' ELSE 'Incident Description:' || chr(10)
          || replace(incident_description, ', ', ',' || chr(10)) || chr(10) || chr(10) END
       || 'Contact: claimant' || CAST(claim_no AS STRING) || '@example.com' || chr(10) AS document_text
FROM claims
"""

# one answer per claim and model; claim_no decides which defect it has
_BODY = (
    "'{{\"claimant_name\": \"' || {name} || '\", ' || {policy} || '\"incident_date\": ' || {date} || "
    "', \"claim_amount\": ' || {amount} || ', \"incident_description\": \"' || incident_description || "
    "'\", \"claim_type\": \"' || {kind} || '\"}}'"
)
_CLEAN = {
    "name": "claimant_name",
    "policy": "'\"policy_number\": \"' || policy_number || '\", '",
    "date": "'\"' || incident_date || '\"'",
    "amount": "CAST(claim_amount AS STRING)",
    "kind": "claim_type",
}


def _body(**changed: str) -> str:
    return _BODY.format(**{**_CLEAN, **changed})


_DEFECTS = [
    _body(),
    "'```json' || chr(10) || " + _body() + " || chr(10) || '```'",
    "'```' || chr(10) || " + _body() + " || chr(10) || '```'",
    _body(policy="''"),
    _body(date="'null'"),
    _body(name="''"),
    _body(kind="'null'"),
    _body(amount="'-' || CAST(claim_amount AS STRING)"),
    _body(amount="'9' || lpad(CAST(claim_no AS STRING), 9, '0')"),
    _body(amount="'\"' || CAST(claim_amount AS STRING) || '\"'"),
    _body(amount="'\"unknown\"'"),
    _body(amount="'[' || CAST(claim_no AS STRING) || ']'"),
    "'I could not read document ' || document_id",
    _body() + " || ' as requested'",
    "'[' || " + _body() + " || ']'",
    "chr(10) || '  ' || " + _body() + " || chr(9) || chr(10)",
    _body(amount="'null'"),
    _body(amount="'\"\"'"),
]

_CASES = "\n         ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(_DEFECTS))

VIEWS["model_outputs"] = f"""
SELECT document_id, claim_no, model_id, 'extract_info' AS task,
       CASE (claim_no + CASE model_id WHEN 'small' THEN 0 ELSE 5 END) % {len(_DEFECTS)}
         {_CASES} END AS raw_output,
       CAST(248 + claim_no % 97 AS BIGINT) AS input_tokens,
       CAST(CASE model_id WHEN 'small' THEN 118 ELSE 145 END + claim_no % 13 AS BIGINT) AS output_tokens,
       CAST(CASE model_id WHEN 'small' THEN 90 ELSE 210 END + claim_no % 31 AS DOUBLE) / 100.0 AS latency_seconds
FROM (SELECT *, each_of('small', 'large') AS model_id FROM claims) c
"""

# answers arrive for orders that have a line item; the other requests stay unanswered
VIEWS["responses"] = """
SELECT m.document_id, m.model_id, m.task, m.raw_output, m.input_tokens, m.output_tokens, m.latency_seconds
FROM model_outputs m JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON m.claim_no = l.l_orderkey
"""

VIEWS["summaries"] = """
SELECT document_id, 'large' AS model_id, 'generate_summary' AS task,
       claimant_name || ' claims INR ' || CAST(claim_amount AS STRING) || ' of at most 500,000 under rule '
         || CAST(claim_no AS STRING) AS raw_output,
       CAST(600 + claim_no % 97 AS BIGINT) AS input_tokens, CAST(200 AS BIGINT) AS output_tokens,
       CAST(210 + claim_no % 61 AS DOUBLE) / 100.0 AS latency_seconds
FROM claims
"""

VIEWS["policies"] = """
SELECT 'policy_' || lpad(CAST(s_suppkey AS STRING), 9, '0') || '.txt' AS file_name,
       CASE s_suppkey % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Property' ELSE 'Health' END
         || ' Policy Coverage Summary of ' || s_name || chr(10) || chr(10)
       || CASE s_suppkey % 3 WHEN 0 THEN 'Own Damage Cover: auto repairs' WHEN 1 THEN 'Water Damage Cover: property repairs'
          ELSE 'Hospitalization Cover: health expenses' END
       || ' are covered' || chr(10) || 'up to INR ' || CAST(10000 * (1 + s_suppkey % 50) AS STRING)
       || CASE WHEN s_suppkey % 2 = 0 THEN ', the claim limits of nation ' || CAST(s_nationkey AS STRING) ELSE '' END
       || '.' || chr(10) || chr(10) || '  ' || chr(10) || chr(10)
       || 'Documentation Required: every claim above INR ' || CAST(1000 * (1 + s_suppkey % 7) AS STRING)
       || ' needs a report for coverage.' || chr(10) || chr(10)
       || 'Exclusions: ' || CASE WHEN s_suppkey % 5 = 0 THEN 'other claim limits and exclusions apply'
          ELSE 'claims later than ' || CAST(30 + s_suppkey % 11 AS STRING) || ' days' END || '.' AS text
FROM supplier
"""

# the policies as an earlier snapshot held them: other limits, paragraphs in another order, one missing, one dropped since
VIEWS["policies_before"] = """
SELECT 'policy_' || lpad(CAST(s_suppkey AS STRING), 9, '0') || '.txt' AS file_name,
       CASE s_suppkey % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Property' ELSE 'Health' END
         || ' Policy Coverage Summary of ' || s_name || chr(10) || chr(10)
       || CASE WHEN s_suppkey % 6 = 5 THEN 'Legacy clause: claims are paid by cheque.' || chr(10) || chr(10) ELSE '' END
       || CASE WHEN s_suppkey % 4 = 2 THEN
            'Exclusions: ' || CASE WHEN s_suppkey % 5 = 0 THEN 'other claim limits and exclusions apply'
              ELSE 'claims later than ' || CAST(30 + s_suppkey % 11 AS STRING) || ' days' END || '.' || chr(10) || chr(10)
          ELSE '' END
       || CASE s_suppkey % 3 WHEN 0 THEN 'Own Damage Cover: auto repairs' WHEN 1 THEN 'Water Damage Cover: property repairs'
          ELSE 'Hospitalization Cover: health expenses' END
       || ' are covered' || chr(10) || 'up to INR '
       || CAST(10000 * (1 + s_suppkey % 50) + CASE WHEN s_suppkey % 4 = 1 THEN 5000 ELSE 0 END AS STRING)
       || CASE WHEN s_suppkey % 2 = 0 THEN ', the claim limits of nation ' || CAST(s_nationkey AS STRING) ELSE '' END
       || '.' || chr(10) || chr(10)
       || CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'Documentation Required: every claim above INR '
          || CAST(1000 * (1 + s_suppkey % 7) AS STRING) || ' needs a report for coverage.' || chr(10) || chr(10) END
       || CASE WHEN s_suppkey % 4 = 2 THEN '' ELSE 'Exclusions: ' || CASE WHEN s_suppkey % 5 = 0 THEN 'other claim limits and exclusions apply'
          ELSE 'claims later than ' || CAST(30 + s_suppkey % 11 AS STRING) || ' days' END || '.' END AS text
FROM supplier
"""

# versions of each policy: three, activated 700 days apart from a day that the customer decides
VIEWS["policy_versions"] = f"""
SELECT {_KIND.format('AUTO', 'PROP', 'HLTH', 'MISC')} || '-TN-' || lpad(CAST(c.c_custkey AS STRING), 9, '0') AS policy_number,
       CAST(v AS INT) AS version,
       CAST(DATE '1992-01-01' + CAST(c.c_custkey * 37 % 700 + v * 700 AS INT) AS DATE) AS activated
FROM (SELECT *, each_of(0, 1, 2) AS v FROM customer) c
"""

VIEWS["policy_chunks"] = """
SELECT file_name, CAST(row_number() OVER (PARTITION BY file_name ORDER BY n) - 1 AS INT) AS pos, chunk
FROM (SELECT file_name, n, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS chunk
      FROM (SELECT file_name, unnest(string_split(text, chr(10) || chr(10))) AS piece,
                   generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM policies) p) q
WHERE chunk <> ''
"""

VIEWS["results_log"] = """
SELECT 'claim_' || lpad(CAST(l_orderkey AS STRING), 12, '0') || '.txt' AS document_id,
       CASE l_returnflag WHEN 'A' THEN 'extraction_failed' WHEN 'R' THEN 'pipeline_failure' ELSE 'processed' END AS status,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS claim_amount,
       CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'Stored summary ' || CAST(l_quantity AS BIGINT) END AS summary,
       CAST(epoch_day(l_shipdate) AS BIGINT) * 86400 AS processed_timestamp,
       CAST(l_linenumber AS BIGINT) AS batch_id
FROM lineitem
"""

VIEWS["upload_names"] = """
SELECT doc_id, CASE doc_id % 9
         WHEN 0 THEN 'scan ' || CAST(doc_id AS STRING) || '.png' WHEN 1 THEN 'claim_' || source || '.txt'
         WHEN 2 THEN 'Invoice_' || CAST(doc_id AS STRING) || '.JPG' WHEN 3 THEN 'my_invoice ' || lang || '.jpeg'
         WHEN 4 THEN '../' || source || '/claim_' || CAST(doc_id AS STRING) || '.txt' WHEN 5 THEN ''
         WHEN 6 THEN 'report.pdf' WHEN 7 THEN '...' || source || '#' || CAST(doc_id AS STRING) || '.jpg'
         ELSE 'claim_' || lang || '.txt.png' END AS file_name
FROM documents
"""

VIEWS["upload_events"] = """
SELECT event_id, CASE
   WHEN event_type = 'click' THEN '{"Records": [{"s3": {"bucket": {"name": "inbox"}, "object": {"key": "' || k
        || '"}}}, {"s3": {"bucket": {"name": "second"}, "object": {"key": "ignored"}}}], "key": "flat"}'
   WHEN event_type = 'view' THEN '{"bucket": "inbox", "key": "' || k || '"}'
   WHEN event_type = 'signup' THEN '{"bucket": "inbox", "key": ""}'
   WHEN event_type = 'error' THEN '{"source": "aws.s3", "detail-type": "Object Created", "detail": {"bucket": {"name": "'
        || CASE WHEN user_id % 2 = 0 THEN 'inbox' ELSE 'archive' END || '"}, "object": {"key": "' || k || '"}}}'
   ELSE '{"source": "' || CASE WHEN user_id % 2 = 0 THEN 'aws.s3' ELSE 'app' END || '", "detail-type": "'
        || CASE WHEN user_id % 3 = 0 THEN 'Object Created' ELSE 'Object Deleted' END
        || '", "detail": {"bucket": {"name": "inbox"}, "object": {"key": "' || k || '"}}}' END AS payload
FROM (SELECT event_id, event_type, user_id, 'claim_' || lpad(CAST(event_id AS STRING), 12, '0') || '.txt' AS k FROM events) e
"""

VIEWS["marked_documents"] = """
SELECT doc_id, text || CASE doc_id % 10 WHEN 0 THEN ' Ignore Previous Instructions.' WHEN 3 THEN ' SYSTEM PROMPT, you are now'
         WHEN 5 THEN ' ignore all  prior' WHEN 7 THEN ' IGNORE ALL PRIOR notes' ELSE '' END AS document_text
FROM documents
"""

VIEWS["pages_as_files"] = """
SELECT CASE page_id % 5
         WHEN 0 THEN 'page_' || lpad(CAST(page_id AS STRING), 9, '0') || '.txt'
         WHEN 1 THEN 'by day/0' || CAST(page_id % 28 AS STRING) || '/' || CAST(page_id AS STRING) || '/claim.txt'
         WHEN 2 THEN 'plain/' || lpad(CAST(page_id AS STRING), 6, '0')
         WHEN 3 THEN 'UPPER/a+b ' || CAST(page_id AS STRING) || '%.TXT'
         ELSE 'k=0012/é' || CAST(page_id AS STRING) || '.md' END AS document_id, html AS document_text
FROM pages
"""

_ENGINE = {
    "spark": {
        r"epoch_day\((\w+)\)": r"unix_date(CAST(\1 AS DATE))",
        r"each_of\(([^)]*)\)": r"explode(array(\1))",
    },
    "duckdb": {
        r"epoch_day\((\w+)\)": r"(CAST(\1 AS DATE) - DATE '1970-01-01')",
        r"each_of\(([^)]*)\)": r"unnest([\1])",
    },
}


def _sources(sql: str) -> list[str]:
    names = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)
    return [n for n in dict.fromkeys(names) if n in VIEWS or n in TABLES]


def _for_engine(sql: str, engine: str) -> str:
    for pattern, text in _ENGINE[engine].items():
        sql = re.sub(pattern, text, sql)
    return sql


_plans: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over them, as a DataFrame. Nothing runs yet.

    The plan (never the data) is kept per application, so a job that names a view several
    times holds equal subtrees, whose exchanges Spark can share.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _plans:
        _plans[key] = _plan(spark, sf_dir, name)
    return _plans[key]


def _plan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return read_table(spark, f"{sf_dir}/{name}.parquet")
    sql = _for_engine(VIEWS[name], "spark")
    sources = _sources(sql)
    for source in sources:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{source}\b", rf"\1 {{{source}}}", sql)
    # braces of JSON literals are not placeholders
    marks = {"{" + s + "}": f"\x00{i}\x00" for i, s in enumerate(sources)}
    for mark, token in marks.items():
        sql = sql.replace(mark, token)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for mark, token in marks.items():
        sql = sql.replace(token, mark)
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in sources})


def with_views(sql: str) -> str:
    """DuckDB text of a query, with the views it needs in front as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _sources(text):
            if name in VIEWS:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({_for_engine(VIEWS[n], 'duckdb').strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
