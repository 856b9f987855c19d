"""Cross-document fraud check: who else names the same claimant or policy.

Pairs of claims are never formed. All claims that share a name share one needle, so the work
and the tables are per needle: the documents that hold it, and how many there are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.operators.matching import needle_hits
from claimspark.operators.skew import ROWS_PER_SLICE, hot_keys, salted_join
from claimspark.session import materialise

KINDS = {"claimant": "claimant_name", "policy": "policy_number"}


class FraudIndex(NamedTuple):
    """What a check needs from all claims and texts; both tables are stored ones."""

    needles: DataFrame  # needle, n_claims
    hits: DataFrame     # document_id, needle


def _identifiers() -> Column:
    """The two identifiers of a claim as ``kind, identifier, needle`` rows."""
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(kind).alias("kind"), F.col(c).alias("identifier"), F.lower(F.col(c)).alias("needle")
                )
                for kind, c in KINDS.items()
            ]
        )
    )


def fraud_needles(claims: DataFrame) -> DataFrame:
    """``needle, n_claims``: lower-case names and policy numbers and how many claims give them.

    Missing and empty ones are skipped.
    """
    given = claims.select(_identifiers().alias("i")).select("i.needle").where(F.col("needle") != "")
    return given.groupBy("needle").agg(F.count(F.lit(1)).alias("n_claims"))


def fraud_index(claims: DataFrame, texts: DataFrame, text: str = "document_text") -> FraudIndex:
    """Needles of the claims, and the documents whose text holds them.

    Claims and texts have one row per ``document_id`` (see ``latest_results`` for tables that
    keep every delivery). One scan of the texts, no shuffle of them. ``hits`` may hold strings that are no needle;
    every use below joins on the needle and so drops them.
    """
    needles = materialise(fraud_needles(claims), "fraud-needles")
    hits = needle_hits(needles.select("needle"), texts, "document_id", text)
    return FraudIndex(needles, materialise(hits, "fraud-hits"))


def fraud_matches(claims: DataFrame, index: FraudIndex, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``kind, identifier, document_id``: each distinct identifier and each document holding it.

    This is the pair table without the pairs: a claim's matches are the rows of its own two
    identifiers, other than its own document.
    """
    distinct = claims.select(_identifiers().alias("i")).select("i.*").where(F.col("needle") != "").distinct()
    per_needle = index.hits.groupBy("needle").agg(F.count(F.lit(1)).alias("_rows"))
    hot = hot_keys(per_needle, "needle", "_rows", rows_per_slice)
    return salted_join(index.hits, distinct, "needle", F.col("document_id"), hot, "inner").select(
        "kind", "identifier", "document_id"
    )


def fraud_reasons(matches: DataFrame) -> DataFrame:
    """Add ``reason``, the text shown for a match in that document."""
    lead = F.when(F.col("kind") == "claimant", C.MSG_CLAIMANT).otherwise(C.MSG_POLICY)
    return matches.withColumn(
        "reason", F.concat(lead, F.col("identifier"), F.lit(C.MSG_FOUND_IN), F.col("document_id"), F.lit("'"))
    )


def reasons_for(
    checks: DataFrame, matches: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, in_order: bool = False
) -> DataFrame:
    """Reasons of the claims being checked: ``document_id, other_id, ord, reason``.

    For a set of claims under review, as its answer has a row per claim and matching document.
    Order by (document_id, other_id, ord) gives the report order: claimant before policy; ``in_order`` sorts so, before
    the texts are made. No list is collected, since one claimant may match in any number of documents. ``matches`` is
    counted and joined, so it should be cheap to read twice.
    """
    asked = checks.select(F.col("document_id").alias("_check"), _identifiers().alias("i")).select(
        "_check", F.concat_ws("|", "i.kind", "i.identifier").alias("_id")
    )
    known = matches.select(
        F.concat_ws("|", "kind", "identifier").alias("_id"),
        F.col("document_id").alias("other_id"),
        F.when(F.col("kind") == "claimant", 0).otherwise(1).alias("ord"),
    )
    counts = known.groupBy("_id").agg(F.count(F.lit(1)).alias("_rows"))
    hot = hot_keys(counts, "_id", "_rows", rows_per_slice)
    pairs = salted_join(known, asked, "_id", F.col("other_id"), hot, "inner").where(F.col("_check") != F.col("other_id"))
    if in_order:
        pairs = pairs.orderBy("_check", "other_id", "ord")
    # no kind holds the mark, and what was found has an identifier
    told = pairs.select(
        "_check", "other_id", "ord", F.substring_index("_id", "|", 1).alias("kind"), F.col("other_id").alias("document_id"),
        F.substring(F.col("_id"), F.instr("_id", "|") + F.lit(1), F.octet_length("_id")).alias("identifier"),
    )
    return fraud_reasons(told).select(F.col("_check").alias("document_id"), "other_id", "ord", "reason")


def fraud_score(claims: DataFrame, index: FraudIndex, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``document_id, claimant_hits, policy_hits, risk_score`` for every claim, 0 without a hit.

    Documents are counted per needle (a partial count in each task first), and a claim takes
    the counts of its two needles less its own document. The score is 45 and 50 points per
    hit, at most 100.
    """
    counts = index.hits.groupBy("needle").agg(F.count(F.lit(1)).alias("documents"))
    sides = claims.select("document_id", _identifiers().alias("i")).select("document_id", "i.kind", "i.needle")
    # own document: an equality on (document, needle), where no key is hot
    own = index.hits.select("document_id", "needle", F.lit(1).alias("_own"))
    sides = sides.where(F.col("needle") != "").join(own, ["document_id", "needle"], "left")
    hot = hot_keys(index.needles, "needle", "n_claims", rows_per_slice)
    counted = salted_join(sides, counts, "needle", F.col("document_id"), hot, "left").withColumn(
        "others", F.coalesce("documents", F.lit(0)) - F.coalesce("_own", F.lit(0))
    )
    # every claim contributes a zero row, so claims without any needle stay in the answer
    zero = claims.select(
        "document_id", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("bigint").alias("others")
    )
    of_kind = {
        kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("others"))), F.lit(0)) for kind in KINDS
    }
    points = F.lit(C.CLAIMANT_POINTS) * F.col("claimant_hits") + F.lit(C.POLICY_POINTS) * F.col("policy_hits")
    return (
        counted.select("document_id", "kind", "others")
        .unionByName(zero)
        .groupBy("document_id")
        .agg(of_kind["claimant"].alias("claimant_hits"), of_kind["policy"].alias("policy_hits"))
        .withColumn("risk_score", F.least(F.lit(C.MAX_RISK), points).cast("int"))
    )


def fraud_band(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Add ``risk_band`` and ``risk_label``: above 50 High, above 0 Medium, else Low."""
    band = F.when(F.col(score) > 50, "High").when(F.col(score) > 0, "Medium").otherwise("Low")
    return df.withColumn("risk_band", band).withColumn(
        "risk_label", F.concat(F.col(score).cast("string"), F.lit("% "), F.col("risk_band"), F.lit(" Risk"))
    )
