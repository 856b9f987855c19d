"""Result rows: shaping, reading back, latest per document, stored before computed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.functions.numbers import by_key
from claimspark.functions.text import clean_code


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def shape_results(df: DataFrame, now: Column | int | None = None, success: str = C.STATUS_OK) -> DataFrame:
    """Rows of the result table from routed rows (``document_id``, ``status``, ``parsed``, ...).

    Each status fills its own columns: success the claim, flags, summary and metrics; an
    invalid extraction its errors and raw output; a failed run its error. ``now`` is the
    processing time in epoch seconds, current time by default. ``success`` is the stored name of
    the good status. An amount that the table cannot hold as stated leaves a warning with the stated value.
    """
    stamp = F.unix_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    ok = F.col("status").isin(C.STATUS_OK, C.STATUS_STORED_OK)
    invalid = F.col("status") == C.STATUS_INVALID
    amount = F.col("parsed.claim_amount").try_cast("decimal(18,2)")
    stated = F.col("parsed.claim_amount").cast("double")
    unstored = stated.isNotNull() & ~F.coalesce(amount.cast("double") == stated, F.lit(False))
    changed = F.when(unstored, F.array(F.concat(F.lit(C.MSG_AMOUNT_CHANGED), stated.cast("string")))).otherwise(
        F.array().cast("array<string>")
    )
    info = F.struct(
        F.col("parsed.claimant_name").alias("claimant_name"),
        F.col("parsed.policy_number").alias("policy_number"),
        F.col("parsed.incident_date").alias("incident_date"),
        amount.alias("claim_amount"),
        F.col("parsed.incident_description").alias("incident_description"),
        F.col("parsed.claim_type").alias("claim_type"),
    )
    metrics = F.struct(
        _or_null(df, "latency_seconds", "double").alias("extraction_latency_s"),
        _or_null(df, "summary_latency_seconds", "double").alias("summary_latency_s"),
        _or_null(df, "model_id", "string").alias("extraction_model"),
        _or_null(df, "summary_model_id", "string").alias("summary_model"),
    )
    empty = F.array().cast("array<string>")
    return df.select(
        "document_id",
        F.when(ok, success).otherwise(F.col("status")).alias("status"),
        F.when(ok, info).alias("extracted_info"),
        F.when(ok, F.concat(F.coalesce(_or_null(df, "warnings", "array<string>"), empty), changed)).alias("validation_warnings"),
        F.when(ok, F.coalesce(_or_null(df, "injection_flags", "array<string>"), empty)).alias("injection_flags"),
        F.when(ok, _or_null(df, "summary", "string")).alias("summary"),
        F.when(ok, metrics).alias("metrics"),
        stamp.cast("bigint").alias("processed_timestamp"),
        F.when(invalid, F.to_json("errors")).alias("errors"),
        F.when(invalid, F.col("raw_output")).alias("raw_output"),
        F.when(F.col("status") == C.STATUS_FAILED, F.lit(C.MSG_FAILED)).alias("error"),
    )


def read_results(stored: DataFrame) -> DataFrame:
    """Read-side types and defaults: amount double, stamp bigint, empty lists and text for NULL."""
    empty = F.array().cast("array<string>")
    info = F.col("extracted_info")
    return stored.select(
        "document_id",
        F.coalesce(_or_null(stored, "status", "string"), F.lit(C.STATUS_STORED_OK)).alias("status"),
        info.withField("claim_amount", info["claim_amount"].cast("double")).alias("extracted_info"),
        F.coalesce(_or_null(stored, "summary", "string"), F.lit("")).alias("summary"),
        F.coalesce(_or_null(stored, "validation_warnings", "array<string>"), empty).alias("validation_warnings"),
        F.coalesce(_or_null(stored, "injection_flags", "array<string>"), empty).alias("injection_flags"),
        _or_null(stored, "processed_timestamp", "bigint").cast("bigint").alias("processed_timestamp"),
        *([F.col("metrics")] if "metrics" in stored.columns else []),
    )


#: What makes a stored row the newer one; columns that a table lacks are passed over.
ORDER = ("processed_timestamp", "run_id", "batch_id")


def latest_results(df: DataFrame, key: str = "document_id", order: Sequence[str] = ORDER) -> DataFrame:
    """Last writer wins: one row per key, the newest by ``order``.

    Spark limits each task to one row per key before the shuffle, so a key that is written
    over and over does not gather in one task.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order if c in df.columns])
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def lookup_results(results: DataFrame, keys: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Stored rows of the asked documents; keys without a row are absent.

    With an ``order``, ``results`` is the log of all writes, and the newest row of each asked document is
    found: only the log of the asked documents is ranked.
    """
    asked = results.join(keys.select("document_id").distinct(), "document_id", "left_semi")
    return latest_results(asked, order=order) if order else asked


def stored_or_computed(
    docs: DataFrame, results: DataFrame, compute: Callable[[DataFrame], DataFrame], order: Sequence[str] | None = None
) -> DataFrame:
    """Stored result where there is one, else the computed one; ``source`` says which.

    ``compute`` only sees documents without a stored result. ``results`` has one row per document, or is the
    log of all writes where an ``order`` is given.
    """
    stored = lookup_results(results, docs, order)
    missing = docs.join(results.select("document_id").distinct(), "document_id", "left_anti")
    return stored.withColumn("source", F.lit("stored")).unionByName(
        compute(missing).withColumn("source", F.lit("computed")), allowMissingColumns=True
    )


def default_fields(df: DataFrame) -> DataFrame:
    """Form defaults for missing or empty fields: '', 0 and ``auto``."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("claimant_name", "policy_number", "incident_date")}
    amount = F.col("claim_amount").cast("double")
    kind = F.coalesce(F.nullif(F.col("claim_type"), F.lit("")), F.lit("auto"))
    return df.withColumns(
        {**text, "claim_amount": F.coalesce(F.nanvl(amount, F.lit(0.0)), F.lit(0.0)), "claim_type": kind}
    )


def claim_metrics(df: DataFrame, costs: Mapping[str, float], other: float | None = None) -> DataFrame:
    """Add ``total_latency_s`` to two decimals and the flat ``cost_per_claim_usd`` of the claim type."""
    total = F.round(F.col("extraction_latency_s") + F.col("summary_latency_s"), 2)
    return df.withColumns({"total_latency_s": total, "cost_per_claim_usd": by_key(dict(costs), F.col("claim_type"), other)})


def claim_listing(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Listing row per document: ``document_id, badge, code, icon_type``.

    Only the keys of ``results`` are read; a document stored many times is listed once.
    """
    done = results.select("document_id").distinct().withColumn("_done", F.lit(True))
    scan = F.lower("document_id").rlike(r"\.(png|jpg)$")
    return docs.select("document_id").join(done, "document_id", "left").select(
        "document_id",
        F.when(F.col("_done"), "Processed").otherwise("Unprocessed").alias("badge"),
        clean_code(F.col("document_id")).alias("code"),
        F.when(scan, "Scan").otherwise("Doc").alias("icon_type"),
    )
