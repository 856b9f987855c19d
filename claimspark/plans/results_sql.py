"""The newest stored row of each document, in SQL and as an order, for the queries over the log."""

LATEST = """
(SELECT document_id, status, CAST(claim_amount AS DOUBLE) AS claim_amount, summary, processed_timestamp, batch_id
 FROM (SELECT *, row_number() OVER (PARTITION BY document_id
         ORDER BY processed_timestamp DESC, batch_id DESC, claim_amount DESC, status DESC, summary DESC NULLS LAST) AS n
       FROM results_log) x WHERE n = 1)
"""
LATEST_ORDER = ("processed_timestamp", "batch_id", "claim_amount", "status", "summary")
