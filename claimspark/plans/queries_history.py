"""Queries of the roadmap's checks: chunk changes, duplicate bills, the policy in force, equal amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators import history, redact, snapshots
from claimspark.plans.registry import query
from claimspark.plans.views import table
from claimspark.sources.files import chunk_paragraphs


# no SQL: the longest increasing run is tested against a plain one in tests/test_history.py
@query()
def chunk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of the policies' earlier and current snapshots, with its change."""
    old = chunk_paragraphs(table(spark, sf_dir, "policies_before"))
    new = chunk_paragraphs(table(spark, sf_dir, "policies"))
    return snapshots.chunk_changes(old, new)


def _line(quantity: str, discount: str, part: str) -> F.Column:
    return F.concat_ws(
        "|", F.col(part).cast("string"), F.floor(F.col(quantity)).cast("bigint").cast("string"),
        F.round(F.col(discount) * 100).cast("bigint").cast("string"),
    )


@query("""
WITH l AS (
  SELECT l_orderkey AS bill, coalesce(l_returnflag, '') AS section,
         sha256(coalesce(concat_ws('|', CAST(l_partkey AS VARCHAR), CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR),
                         CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR)), '')) AS line_hash
  FROM lineitem),
s AS (SELECT bill, section, sha256(array_to_string(list_sort(list(line_hash)), ',')) AS section_hash, count(*) AS n_lines
      FROM l GROUP BY bill, section),
b AS (SELECT bill, sum(n_lines) AS n_lines, count(*) AS n_sections,
             sha256(array_to_string(list_sort(list(section || ':' || section_hash)), ',')) AS bill_hash
      FROM s GROUP BY bill),
d AS (SELECT o_orderkey AS bill, CAST(o_orderdate AS TIMESTAMP) AS dated FROM orders),
bd AS (SELECT b.*, coalesce(d.dated, TIMESTAMP '9999-12-31') AS dated FROM b LEFT JOIN d USING (bill)),
sd AS (SELECT s.*, coalesce(d.dated, TIMESTAMP '9999-12-31') AS dated FROM s LEFT JOIN d USING (bill)),
bf AS (SELECT bill_hash, bill AS first_bill FROM (
         SELECT bill_hash, bill, row_number() OVER (PARTITION BY bill_hash ORDER BY dated, bill) AS r FROM bd) x WHERE r = 1),
sf AS (SELECT section_hash, bill AS first_bill FROM (
         SELECT section_hash, bill, row_number() OVER (PARTITION BY section_hash ORDER BY dated, bill) AS r FROM sd) x WHERE r = 1),
sh AS (SELECT sd.bill, sum(CASE WHEN sf.first_bill <> sd.bill THEN 1 ELSE 0 END) AS n_shared
       FROM sd JOIN sf USING (section_hash) GROUP BY sd.bill)
SELECT bd.bill AS claim_no, CAST(bd.n_lines AS BIGINT) AS n_lines, CAST(bd.n_sections AS BIGINT) AS n_sections,
       bd.bill_hash AS bill_sha256, bf.first_bill AS first_claim_no, bf.first_bill <> bd.bill AS duplicate,
       CAST(coalesce(sh.n_shared, 0) AS BIGINT) AS n_shared_sections
FROM bd JOIN bf USING (bill_hash) LEFT JOIN sh USING (bill)
""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's bill (its line items, in sections by return flag) against the bills of earlier claims."""
    lines = table(spark, sf_dir, "lineitem")
    sections, bills = history.hash_tree(lines, "l_orderkey", "l_returnflag", _line("l_quantity", "l_discount", "l_partkey"))
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill"), "o_orderdate")
    found = history.duplicate_bills(sections, bills, dates, "o_orderdate")
    return found.select(
        F.col("bill").alias("claim_no"), F.col("n_lines").cast("bigint"), F.col("n_sections").cast("bigint"),
        F.col("bill_hash").alias("bill_sha256"), F.col("first_bill").alias("first_claim_no"), "duplicate", "n_shared_sections",
    )


@query("""
WITH m AS (
  SELECT c.claim_no, max(struct_pack(a := v.activated, n := v.version)) AS best
  FROM claims c JOIN policy_versions v ON v.policy_number = c.policy_number AND v.activated <= CAST(c.incident_date AS DATE)
  GROUP BY c.claim_no)
SELECT c.claim_no, c.policy_number, c.incident_date, m.best.n AS version, CAST(m.best.a AS VARCHAR) AS activated,
       coalesce(CAST(m.best.a AS VARCHAR) = c.incident_date, false) AS on_activation
FROM claims c LEFT JOIN m USING (claim_no)
""")
def activation_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim with the version of its policy in force on the incident date; incidents on the day of activation."""
    claims = table(spark, sf_dir, "claims").select("claim_no", "policy_number", "incident_date")
    found = history.version_in_force(claims, table(spark, sf_dir, "policy_versions"), "policy_number", "incident_date", "activated", "version")
    return found.select(
        "claim_no", "policy_number", "incident_date", "version", F.col("activated").cast("string").alias("activated"),
        F.coalesce(F.col("activated").cast("string") == F.col("incident_date"), F.lit(False)).alias("on_activation"),
    )


@query("""
SELECT CAST(claim_amount AS VARCHAR) AS claim_amount, CAST(sum(n) AS BIGINT) AS n_claims, CAST(count(*) AS BIGINT) AS n_policies, min(first) AS first_claim
FROM (SELECT claim_amount, policy_number, count(*) AS n, min(claim_no) AS first FROM claims
      WHERE claim_amount IS NOT NULL AND policy_number IS NOT NULL GROUP BY claim_amount, policy_number) p
GROUP BY claim_amount HAVING count(*) > 1
""")
def shared_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that claims on more than one policy ask for: one row per amount."""
    found = history.shared_amounts(table(spark, sf_dir, "claims"), "claim_amount", "policy_number", "claim_no")
    return found.select(
        F.col("claim_amount").cast("string").alias("claim_amount"), F.col("n_claims").cast("bigint"),
        F.col("n_policies").cast("bigint"), "first_claim"
    )


# no SQL: the recognisers' check digits and the leftmost-longest rule are tested on planted cases in tests/test_history.py
@query()
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with its personal data replaced by keyed pseudonyms: what was found, and a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", redact.redacted(F.col("text")).alias("r"))
    return docs.select(
        "doc_id", F.size("r.finds").cast("bigint").alias("n_finds"),
        F.array_join(F.array_sort(F.array_distinct(F.col("r.finds.kind"))), ",").alias("kinds"),
        F.sha2(F.col("r.redacted"), 256).alias("redacted_sha256"),
    )
