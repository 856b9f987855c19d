"""Comparison of extraction models on the same documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.functions.text import JSON_SPACE, strip_code_fence
from claimspark.operators.prompts import estimate_cost, join_responses
from claimspark.operators.validate import validate_extractions

TASK = "extract_info"


def compare_requests(docs: DataFrame, models: Sequence[str], key: str = "document_id") -> DataFrame:
    """One request per document and model: ``document_id, model_id, task``.

    The model list is an argument of at least two, so rows are multiplied in place, unjoined.
    """
    names = list(dict.fromkeys(m for m in models if m))
    if len(names) < 2:
        raise ValueError("comparing needs at least two different model ids")
    return docs.select(
        F.col(key).alias("document_id"),
        F.explode(F.array(*[F.lit(m) for m in names])).alias("model_id"),
        F.lit(TASK).alias("task"),
    )


def compare_models(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``document_id, model, latency_s, input_tokens, output_tokens, valid_json, warnings`` and
    two accuracy flags: ``first_try_json`` (valid without removing fences) and ``all_fields``.
    """
    judged = validate_extractions(join_responses(requests, responses))
    return judged.select(
        "document_id",
        F.col("model_id").alias("model"),
        F.col("latency_seconds").alias("latency_s"),
        "input_tokens",
        "output_tokens",
        F.col("is_valid").alias("valid_json"),
        F.coalesce(F.size("warnings"), F.lit(0)).alias("warnings"),
        _first_try().alias("first_try_json"),
        (F.col("is_valid") & ~F.exists("warnings", lambda w: w.startswith("Field '"))).alias("all_fields"),
    )


def _first_try() -> Column:
    """JSON as answered: the object was found, and no fence had to be removed before it."""
    raw = F.col("raw_output")
    as_answered = F.btrim(raw, F.lit(JSON_SPACE)) == strip_code_fence(raw)
    return as_answered & ~F.array_contains("errors", C.MSG_NOT_JSON)


def model_summary(
    cmp: DataFrame, prices: Mapping[str, tuple[float, float]] = C.TOKEN_PRICES, valid_share: bool = False
) -> DataFrame:
    """Averages per model, and the cost of a thousand documents; with ``valid_share`` also that share."""
    averages = cmp.groupBy(F.col("model").alias("model_id")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("latency_s").alias("avg_latency_s"),
        F.avg("input_tokens").alias("input_tokens"),
        F.avg("output_tokens").alias("output_tokens"),
        F.avg(F.coalesce("valid_json", F.lit(False)).cast("int")).alias("valid_share"),
    )
    return estimate_cost(averages, prices).select(
        F.col("model_id").alias("model"),
        "documents",
        "avg_latency_s",
        F.col("input_tokens").alias("avg_input_tokens"),
        F.col("output_tokens").alias("avg_output_tokens"),
        (F.col("cost_usd") * 1000).alias("cost_per_1000_usd"),
        *(["valid_share"] if valid_share else []),
    )


def extraction_accuracy(cmp: DataFrame) -> DataFrame:
    """Share of documents per model: valid, all fields filled, JSON on the first try."""
    def share(flag: str) -> Column:
        return F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int"))

    return cmp.groupBy("model").agg(
        F.count(F.lit(1)).alias("documents"),
        share("valid_json").alias("valid_share"),
        share("all_fields").alias("all_fields_share"),
        share("first_try_json").alias("first_try_share"),
    )


def pick_model(summary: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """The cheapest of the most accurate models; one row, ties by name.

    ``summary`` alone is enough where it has the share of valid answers itself.
    """
    both = summary if accuracy is None else summary.join(accuracy.select("model", "valid_share"), "model")
    return (
        both.orderBy(F.desc("valid_share"), "cost_per_1000_usd", "model")
        .limit(1)
        .select("model", "valid_share", "cost_per_1000_usd")
    )


def status_counts(results: DataFrame, by_type: bool = False) -> DataFrame:
    """Rows per status; with ``by_type`` also per claim type, with subtotals (NULL = all)."""
    grouped = results.rollup("claim_type", "status") if by_type else results.groupBy("status")
    return grouped.agg(F.count(F.lit(1)).alias("n"))
