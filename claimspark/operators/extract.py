"""Fields and flags read directly from document text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.functions.numbers import to_number
from claimspark.functions.text import fold_newlines, strip_ws

# Labels of the claim form, with their variants.
LABELS = {
    "claimant_name": "Claimant Name",
    "policy_number": "Policy Number",
    "incident_date": "Date of (?:Incident Photo|Incident|Invoice)",
    "claim_amount": "Claim Amount Requested",
}
DESCRIPTION = r"(?ms)^Incident Description:[ \t]*\n?(.*?)(?:\n[ \t]*\n|\z)"


def _labelled(text: Column, label: str) -> Column:
    """What stands after the label; empty where nothing does."""
    return strip_ws(F.regexp_extract(text, rf"(?md)^{label}:[ \t]*(.*)$", 1))


def _stated(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def extract_fields(df: DataFrame, text: str = "document_text", amount_text: bool = False) -> DataFrame:
    """Add the six claim fields as stated on the form; NULL for what is not stated.

    The amount loses its currency word or sign, digit commas and a closing ``/-``; ``amount_text`` adds what is
    then left of it as ``claim_amount_text``, which tells an unreadable amount from an absent one. The description runs to the next
    blank line and is folded onto one line. Nothing is inferred except ``claim_type``, which
    the policy prefix decides.
    """
    # each reading is a column before it is used more than once: an expression named twice is evaluated twice
    told = F.regexp_replace(F.regexp_extract(F.col("_body"), DESCRIPTION, 1), r"\s+", " ")
    read = df.withColumn("_body", fold_newlines(F.col(text))).withColumns(
        {**{f"_{name}": _labelled(F.col("_body"), label) for name, label in LABELS.items()}, "_told": strip_ws(told)}
    )
    bare = F.regexp_replace(F.regexp_replace(_stated("_claim_amount"), r"^(?i:INR|Rs\.?|₹)\s*", ""), r"\s*/[-=]?$", "")
    fields = read.withColumn("_amount", F.regexp_replace(bare, ",", "")).withColumns(
        {
            "claimant_name": _stated("_claimant_name"),
            "policy_number": _stated("_policy_number"),
            "incident_date": _stated("_incident_date"),
            "claim_amount": to_number(F.col("_amount")),
            "incident_description": _stated("_told"),
            **({"claim_amount_text": F.col("_amount")} if amount_text else {}),
        }
    )
    return classify_claim_type(fields).drop("_body", "_told", "_amount", *(f"_{name}" for name in LABELS))


def classify_claim_type(
    df: DataFrame, policy_number: str = "policy_number", rules: Mapping[str, str] = C.POLICY_PREFIXES
) -> DataFrame:
    """Add ``claim_type`` from the prefix before the first dash, else ``other``."""
    out = F.lit("other")
    for prefix, kind in rules.items():
        out = F.when(F.startswith(F.col(policy_number), F.lit(prefix + "-")), kind).otherwise(out)
    return df.withColumn("claim_type", out)


def flag_injections(
    df: DataFrame, text: str = "document_text", markers: Sequence[str] = C.INJECTION_MARKERS
) -> DataFrame:
    """Add ``injection_flags``: the markers found, ignoring case, in marker order.

    The text is lowered once, in a projection of its own, and only tested, never copied on.
    """
    found = [F.when(F.contains(F.col("_lower"), F.lit(m.lower())), F.lit(m)) for m in markers]
    return (
        df.withColumn("_lower", F.lower(F.col(text)))
        .withColumn("injection_flags", F.array_compact(F.array(*found)))
        .drop("_lower")
    )
