"""Policy rules applied to claims, adjuster summaries, and the check of their figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.functions.text import figures, format_inr

_COMPARE = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
}


def lookup_policy_rules(
    df: DataFrame, rules: Mapping[str, tuple[str, list[str]]] = C.POLICY_RULES, claim_type: str = "claim_type"
) -> DataFrame:
    """Add ``policy_title`` and ``policy_rules``; unknown types are uncategorised.

    The rules are a fixed handful, so they become a CASE expression and need no join.
    """
    def entry(title: str, texts: list[str]) -> Column:
        return F.struct(F.lit(title).alias("title"), F.array(*[F.lit(t) for t in texts]).alias("rules"))

    found = entry(*C.UNCATEGORISED)
    for kind, (title, texts) in rules.items():
        found = F.when(F.col(claim_type) == kind, entry(title, texts)).otherwise(found)
    return (
        df.withColumn("_rule", found)
        .withColumns({"policy_title": F.col("_rule.title"), "policy_rules": F.col("_rule.rules")})
        .drop("_rule")
    )


def evaluate_coverage_rules(
    df: DataFrame,
    rules: Sequence[tuple] = C.COVERAGE_RULES,
    amount: str = "claim_amount",
    incident_date: str = "incident_date",
    filed_date: str | None = None,
) -> DataFrame:
    """Add ``rule_codes`` and ``rule_notes``: the rules a claim triggers, in rule order.

    A rule compares the amount, or the days from incident to filing, with its bound. Without
    a filing date, or with one that is no date, the delay rules do not fire. Every claim is judged on its own row: the range
    condition needs no join because the rule list is fixed and short.
    """
    # Spark orders NaN above every number; here it is no amount
    measures = {"amount": F.nanvl(F.col(amount).try_cast("double"), F.lit(None).cast("double"))}
    if filed_date is not None:
        measures["delay_days"] = F.datediff(
            F.col(filed_date).try_cast("date"), F.try_to_timestamp(F.col(incident_date), F.lit("yyyy-MM-dd")).cast("date")
        ).cast("double")
    codes, notes = [], []
    for kind, code, measure, comparison, bound, note in rules:
        if measure not in measures:
            continue
        fires = (F.col("claim_type") == kind) & _COMPARE[comparison](measures[measure], F.lit(float(bound)))
        codes.append(F.when(fires, F.lit(code)))
        notes.append(F.when(fires, F.lit(note)))
    return df.withColumns(
        {"rule_codes": F.array_compact(F.array(*codes)), "rule_notes": F.array_compact(F.array(*notes))}
    )


def summarise_claims(df: DataFrame) -> DataFrame:
    """Add ``summary``: what happened, the amount, the policy that applies, what to check.

    Needs the claim fields, ``policy_title`` and ``rule_notes``. Sentences whose facts are
    missing are left out.
    """
    told = F.rtrim(F.col("incident_description"))
    happened = F.when(told.endswith("."), told).otherwise(F.concat(told, F.lit(".")))
    opening = F.concat(
        F.coalesce(F.col("claimant_name"), F.lit("The claimant")),
        F.lit(" claims INR "),
        format_inr(F.col("claim_amount")),
        F.coalesce(F.concat(F.lit(" for an incident on "), F.col("incident_date")), F.lit("")),
        F.lit("."),
    )
    checks = F.when(
        F.size("rule_notes") > 0, F.concat(F.lit("Check: "), F.concat_ws("; ", F.col("rule_notes")), F.lit("."))
    ).otherwise(F.lit("No coverage rule needs a manual check."))
    policy = F.concat(F.lit("Policy: "), F.col("policy_title"), F.lit("."))
    return df.withColumn("summary", F.concat_ws(" ", opening, happened, policy, checks))


def grounding_check(df: DataFrame, summary: str, sources: Sequence[str]) -> DataFrame:
    """Add ``ungrounded`` (figures of the summary found in no source text) and ``is_grounded``."""
    known = F.array_union(F.array().cast("array<string>"), figures(F.concat_ws(" ", *[F.col(s) for s in sources])))
    return df.withColumn("ungrounded", F.array_except(figures(F.col(summary)), known)).withColumn(
        "is_grounded", F.size("ungrounded") == 0
    )
