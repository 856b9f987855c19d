"""Checks on a model's extraction, and the status that follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.functions.jsontext import boolean_field, strict_object
from claimspark.functions.numbers import to_number
from claimspark.functions.text import strip_code_fence


def parse_extraction(df: DataFrame, raw: str = "raw_output", fields: Sequence[str] = C.REQUIRED_FIELDS) -> DataFrame:
    """Add ``cleaned``, ``is_object``, and per field ``<f>_present`` and ``<f>_value``."""
    read = strict_object(df.withColumn("cleaned", strip_code_fence(F.col(raw))), "cleaned", fields, "_read")
    columns = {"is_object": F.col("_read").isNotNull()}
    for name in fields:
        columns[f"{name}_present"] = F.coalesce(F.array_contains("_read.keys", name), F.lit(False))
        columns[f"{name}_value"] = F.col(f"_read.values.{name}")
    return read.withColumns(columns).drop("_read")


def check_required_fields(df: DataFrame, fields: Sequence[str] = C.REQUIRED_FIELDS) -> DataFrame:
    """Add ``missing_errors`` (absent fields) and ``empty_warnings`` (null, '' or 'null')."""
    missing, empty = [], []
    for name in fields:
        present, value = F.col(f"{name}_present"), F.col(f"{name}_value")
        missing.append(F.when(F.col("is_object") & ~present, F.lit(C.MSG_MISSING + name)))
        hollow = value.isNull() | value.isin("", "null")
        empty.append(F.when(F.col("is_object") & present & hollow, F.lit(C.MSG_EMPTY.format(field=name))))
    return df.withColumns(
        {
            "missing_errors": F.array_compact(F.array(*missing)),
            "empty_warnings": F.array_compact(F.array(*empty)),
        }
    )


def check_claim_amount(df: DataFrame, max_amount: float = C.MAX_PLAUSIBLE_AMOUNT) -> DataFrame:
    """Add ``amount`` (double), ``amount_errors`` and ``amount_warnings``; NULL is not checked.

    A JSON true or false counts as 1 or 0. NaN is a number that is neither negative nor large.
    """
    raw = F.col("claim_amount_value")
    unquoted = F.when(raw.rlike(r'^"-?(NaN|Infinity)"$'), F.regexp_replace(raw, '"', "")).otherwise(raw)
    truth = F.when(raw.isin("true", "false"), boolean_field(F.col("cleaned"), "claim_amount"))
    number = F.coalesce(F.when(truth, 1.0).when(~truth, 0.0), to_number(unquoted))
    shown = F.when(raw.rlike(r"^[\[{]"), raw).otherwise(F.concat(F.lit("'"), raw, F.lit("'")))
    amount = F.col("amount")
    errors = F.array(
        F.when(raw.isNotNull() & amount.isNull(), F.concat(F.lit(C.MSG_NOT_NUMERIC), shown)),
        F.when(amount < 0, F.lit(C.MSG_NEGATIVE)),
    )
    large = (amount > F.lit(float(max_amount))) & ~F.isnan(amount)
    return df.withColumn("amount", number).withColumns(
        {
            "amount_errors": F.array_compact(errors),
            "amount_warnings": F.array_compact(F.array(F.when(large, F.lit(C.MSG_LARGE)))),
        }
    )


def validate_extractions(
    df: DataFrame,
    raw: str = "raw_output",
    fields: Sequence[str] = C.REQUIRED_FIELDS,
    max_amount: float = C.MAX_PLAUSIBLE_AMOUNT,
) -> DataFrame:
    """Add ``parsed`` (claim struct), ``errors``, ``warnings``, ``is_valid``.

    Valid means no errors; warnings alone do not fail an extraction. A NULL answer is not JSON.
    """
    keep = df.columns
    checked = check_claim_amount(check_required_fields(parse_extraction(df, raw, fields), fields), max_amount)
    not_json = F.when(~F.col("is_object"), F.array(F.lit(C.MSG_NOT_JSON)))
    found = F.concat(F.col("missing_errors"), F.col("amount_errors"))
    parsed = F.struct(
        *[
            (F.col("amount") if name == "claim_amount" else F.col(f"{name}_value")).alias(name)
            for name in C.REQUIRED_FIELDS
            if name in fields
        ]
    )
    return checked.select(
        *keep,
        F.when(F.col("is_object"), parsed).alias("parsed"),
        F.coalesce(not_json, found).alias("errors"),
        F.concat(F.col("empty_warnings"), F.col("amount_warnings")).alias("warnings"),
        (F.col("is_object") & (F.size(found) == 0)).alias("is_valid"),
    )


def route_status(df: DataFrame) -> DataFrame:
    """Add ``status``: run failure first, then invalid extraction, else success."""
    run_error = F.col("run_error") if "run_error" in df.columns else F.lit(None).cast("string")
    status = (
        F.when(run_error.isNotNull(), C.STATUS_FAILED)
        .when(F.coalesce(F.col("is_valid"), F.lit(False)), C.STATUS_OK)
        .otherwise(C.STATUS_INVALID)
    )
    return df.withColumn("status", status)


def split_by_status(df: DataFrame) -> dict[str, DataFrame]:
    """The three branches; success also covers rows already stored as processed."""
    return {
        C.STATUS_OK: df.where(F.col("status").isin(C.STATUS_OK, C.STATUS_STORED_OK)),
        C.STATUS_INVALID: df.where(F.col("status") == C.STATUS_INVALID),
        C.STATUS_FAILED: df.where(F.col("status") == C.STATUS_FAILED),
    }
