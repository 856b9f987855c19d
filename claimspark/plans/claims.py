"""The claim job end to end: documents and model answers in, result rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.operators.coverage import evaluate_coverage_rules, lookup_policy_rules, summarise_claims
from claimspark.operators.extract import extract_fields, flag_injections
from claimspark.operators.prompts import join_responses, render_prompt
from claimspark.operators.results import shape_results
from claimspark.operators.retrieve import attach_context
from claimspark.operators.validate import route_status, validate_extractions

EXTRACT = "extract_info"
SUMMARY = "generate_summary"


def form_answers(docs: DataFrame) -> DataFrame:
    """Documents with the answer a form reader gives: ``raw_output`` as JSON, from labels.

    Stands where a model would be called, for documents that follow the claim form. An amount that is
    stated but cannot be read goes on as stated, so validation names it.
    """
    read = extract_fields(docs, amount_text=True)
    amount = F.coalesce(F.col("claim_amount").cast("string"), F.col("claim_amount_text"))
    fields = [amount.alias(c) if c == "claim_amount" else F.col(c) for c in C.REQUIRED_FIELDS]
    answer = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return read.withColumn("raw_output", answer).drop(*C.REQUIRED_FIELDS, "claim_amount_text")


def judge(answered: DataFrame) -> DataFrame:
    """Validate and route rows that hold ``raw_output``."""
    return route_status(validate_extractions(answered))


def process_forms(docs: DataFrame, now: Column | int | None = None) -> DataFrame:
    """Claim forms to result rows without any model: one pass, no shuffle.

    Invalid rows skip the rules and the summary; the text is not carried past extraction.
    """
    routed = judge(form_answers(flag_injections(docs)).drop("document_text"))
    claim = routed.withColumns({name: F.col(f"parsed.{name}") for name in C.REQUIRED_FIELDS})
    told = summarise_claims(evaluate_coverage_rules(lookup_policy_rules(claim)))
    return shape_results(told, now)


def process_events(events: DataFrame, docs: DataFrame, now: Column | int | None = None) -> DataFrame:
    """Upload events to result rows: each named document is read and processed once.

    ``events`` are normalised (``document_id, run_error``). An event without a key, and one whose document
    is not there, end as failure rows; an earlier ``run_error`` stays.
    """
    asked = events.groupBy("document_id").agg(F.min("run_error").alias("run_error"))
    read = asked.join(docs.select("document_id", "document_text"), "document_id", "left")
    lost = F.when(F.col("document_text").isNull(), F.lit(C.MSG_FAILED))
    return process_forms(read.withColumn("run_error", F.coalesce("run_error", lost)), now)


def extraction_requests(docs: DataFrame, model_id: str) -> DataFrame:
    """Requests of the extraction task, one per document, prompts rendered."""
    keyed = docs.withColumns({"model_id": F.lit(model_id), "task": F.lit(EXTRACT)})
    return render_prompt(keyed, EXTRACT, {"document_text": F.col("document_text")}).select(
        "document_id", "model_id", "task", "system", "prompt"
    )


def judged_claims(docs: DataFrame, responses: DataFrame, model_id: str) -> DataFrame:
    """Documents with flags, joined to their extraction answers, validated and routed.

    The flags are computed before the join, so only keys and flags are shuffled, not texts.
    """
    keyed = flag_injections(docs).select(
        "document_id", F.lit(model_id).alias("model_id"), F.lit(EXTRACT).alias("task"), "injection_flags"
    )
    return judge(join_responses(keyed, responses))


def summary_requests(judged: DataFrame, contexts: DataFrame, model_id: str) -> DataFrame:
    """Requests of the summary task, for valid claims only, with their policy context."""
    good = judged.where(F.col("status") == C.STATUS_OK).select(
        "document_id", "parsed", F.col("parsed.claim_type").alias("claim_type")
    )
    with_context = attach_context(good, contexts)
    bindings = {
        "extracted_info": F.to_json("parsed", {"ignoreNullFields": "false"}),
        "policy_context": F.col("context"),
    }
    keyed = with_context.withColumns({"model_id": F.lit(model_id), "task": F.lit(SUMMARY)})
    return render_prompt(keyed, SUMMARY, bindings).select("document_id", "model_id", "task", "system", "prompt")


def finish_claims(
    judged: DataFrame, responses: DataFrame, summary_model: str, now: Column | int | None = None
) -> DataFrame:
    """Join the summaries to the valid claims and shape all rows; a missing summary fails its row."""
    answers = responses.where((F.col("task") == SUMMARY) & (F.col("model_id") == summary_model)).select(
        "document_id",
        F.col("raw_output").alias("summary"),
        F.col("latency_seconds").alias("summary_latency_seconds"),
        F.col("model_id").alias("summary_model_id"),
    )
    unsummed = (F.col("status") == C.STATUS_OK) & F.col("summary").isNull()
    return shape_results(
        judged.join(answers, "document_id", "left").withColumn(
            "status", F.when(unsummed, C.STATUS_FAILED).otherwise(F.col("status"))
        ),
        now,
    )
