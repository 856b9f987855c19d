"""Fields, flags, prompts, coverage rules and summaries on the sample claim forms."""

import gc
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.functions.text import clean_code, figures, format_inr, media_of
from claimspark.operators import coverage, extract, prompts
from claimspark.plans import claims as jobs

AUTO = """INSURANCE CLAIM FORM

Claimant Name: Rajesh Kumar Menon
Policy Number: AUTO-TN-88213
Date of Incident: 2026-05-14
Claim Amount Requested: INR 145000

Incident Description:
A lorry rolled back on a slope and pushed in
the front of the parked car (second row).

Contact: office@claims.example
"""
PROPERTY = """INSURANCE CLAIM FORM

Claimant Name: Priya Subramaniam
Policy Number: PROP-TN-55097
Date of Incident: 2026-06-02
Claim Amount Requested: INR 380000

Incident Description:
A burst pipe on the upper floor
soaked two ceilings.

Contact: desk@claims.example
"""
HEALTH = """INSURANCE CLAIM FORM

Claimant Name: Suresh Babu Iyer
Policy Number: HLTH-TN-31042
Date of Incident: 2026-04-28
Claim Amount Requested: INR 92500

Incident Description:
Operation on the left knee, two nights in the clinic.

Contact: desk@claims.example
"""
INVOICE = (
    "WORKSHOP BILL\n\nClaimant Name: Rajesh Kumar Menon\nPolicy Number: AUTO-TN-88213\n"
    "Date of Invoice: 2026-05-15\nClaim Amount Requested: INR 145000\n"
    "Incident Description: Bonnet and grille replaced, parts 90,000, labour 55,000."
)
DOCS = [("claim_car.txt", AUTO), ("claim_care.txt", HEALTH), ("claim_home.txt", PROPERTY)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "document_id STRING, document_text STRING")


def fields(spark, text):
    return extract.extract_fields(spark.createDataFrame([(text,)], "document_text STRING")).first().asDict()


def test_sample_forms(docs):
    got = {
        r["document_id"]: (r["claimant_name"], r["policy_number"], r["incident_date"], r["claim_amount"], r["claim_type"])
        for r in extract.extract_fields(docs).collect()
    }
    assert got == {
        "claim_car.txt": ("Rajesh Kumar Menon", "AUTO-TN-88213", "2026-05-14", 145000.0, "auto"),
        "claim_home.txt": ("Priya Subramaniam", "PROP-TN-55097", "2026-06-02", 380000.0, "property"),
        "claim_care.txt": ("Suresh Babu Iyer", "HLTH-TN-31042", "2026-04-28", 92500.0, "health"),
    }


def test_description_is_folded_to_the_blank_line(spark):
    assert fields(spark, AUTO)["incident_description"] == (
        "A lorry rolled back on a slope and pushed in the front of the parked car (second row)."
    )


def test_invoice_labels_and_last_line(spark):
    got = fields(spark, INVOICE)
    assert got["incident_date"] == "2026-05-15"
    assert got["incident_description"] == "Bonnet and grille replaced, parts 90,000, labour 55,000."


def test_missing_and_empty_labels_are_null(spark):
    got = fields(spark, "Claimant Name:   \r\nClaim Amount Requested: INR lots\r\nx")
    assert [got[f] for f in C.REQUIRED_FIELDS[:5]] == [None] * 5 and got["claim_type"] == "other"


@pytest.mark.parametrize(("stated", "value"), [
    ("INR 1,45,000/-", 145000.0), ("₹ 5000", 5000.0), ("₹5,000.50", 5000.5), ("Rs. 12/-", 12.0), ("Rs 7", 7.0), ("inr 3 /=", 3.0), ("lots", None), ("INR", None),
])
def test_ways_to_state_an_amount(spark, stated, value):
    assert fields(spark, f"Claim Amount Requested: {stated}\n")["claim_amount"] == value


def test_unreadable_amount_is_told_from_an_absent_one(spark):
    texts = [("a", AUTO.replace("INR 145000", "INR lots")), ("b", AUTO.replace("INR 145000", ""))]
    rows = {r["document_id"]: r for r in jobs.process_forms(spark.createDataFrame(texts, "document_id STRING, document_text STRING"), now=1).collect()}
    assert rows["a"]["status"] == "extraction_failed" and "claim_amount is not numeric: 'lots'" in rows["a"]["errors"]
    assert rows["b"]["status"] == "success" and rows["b"]["extracted_info"]["claim_amount"] is None


@pytest.mark.parametrize("amount", ["1e40", "1e20", "inf", "nan", "145000.555"])
def test_odd_amounts_end_no_job_and_do_not_vanish(spark, amount):
    docs = spark.createDataFrame([("a", AUTO.replace("145000", amount)), ("b", AUTO)], "document_id STRING, document_text STRING")
    rows = {r["document_id"]: r for r in jobs.process_forms(docs, now=1).collect()}
    told = [w for w in rows["a"]["validation_warnings"] if w.startswith("claim_amount cannot be stored as stated: ")]
    stated = told[0].rpartition(": ")[2]
    assert len(told) == 1 and (float(stated) == float(amount) or stated == "NaN" and amount == "nan")
    assert rows["b"]["validation_warnings"] == [] and "1,45,000" in rows["b"]["summary"]


def test_odd_filing_dates_and_amounts_fire_no_rule(spark):
    rows = spark.createDataFrame(
        [("auto", float("nan"), "2026-01-01", "not a date"), ("auto", 1.0, "2026-01-01", None)],
        "claim_type STRING, claim_amount DOUBLE, incident_date STRING, filed STRING",
    )
    assert all(r["rule_codes"] == [] for r in coverage.evaluate_coverage_rules(rows, filed_date="filed").collect())


def test_fixed_texts():
    """Texts that users match on, written out here and not taken from the library."""
    assert C.INJECTION_MARKERS[0] == "ignore previous instructions"
    assert C.MSG_NOT_JSON == "Model did not return valid JSON: not a JSON object"
    assert C.MSG_FAILED == "An unexpected pipeline execution error occurred"
    assert C.MSG_NO_KEY == "Missing document key in event"


def test_windows_newlines(spark):
    assert fields(spark, AUTO.replace("\n", "\r\n"))["policy_number"] == "AUTO-TN-88213"


def test_labels_only_at_line_start(spark):
    assert fields(spark, "See Policy Number: AUTO-1\n")["policy_number"] is None


def test_flags_keep_marker_order_and_ignore_case(spark):
    texts = ["You are NOW. Ignore Previous Instructions", "fine", "system  prompt", "SYSTEM PROMPT ignore all prior", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, document_text STRING")
    got = {r["i"]: r["injection_flags"] for r in extract.flag_injections(rows).collect()}
    assert got == {
        0: ["ignore previous instructions", "you are now"], 1: [], 2: [], 3: ["ignore all prior", "system prompt"], 4: [],
    }


def test_prompt_bindings(spark):
    rows = spark.createDataFrame([("100% {policy_context} {document_text}",)], "t STRING")
    got = prompts.render_prompt(rows, "extract_info", {"document_text": F.col("t")}).first()
    assert got["prompt"].endswith("Document:\n100% {policy_context} {document_text}")
    assert got["system"] == C.EXTRACT_SYSTEM
    with pytest.raises(ValueError, match="Unknown template"):
        prompts.render_prompt(rows, "nope", {})
    with pytest.raises(KeyError):
        prompts.render_prompt(rows, "generate_summary", {"extracted_info": F.col("t")})


def test_tokens_and_cost(spark):
    rows = spark.createDataFrame([("small", "x" * 1007), ("else", "x")], "model_id STRING, prompt STRING")
    assert [r["input_tokens"] for r in prompts.estimate_tokens(rows, "prompt").collect()] == [252, 1]
    assert [r["input_tokens"] for r in prompts.estimate_tokens(rows, "prompt", 10).collect()] == [101, 1]
    priced = prompts.estimate_cost(
        spark.createDataFrame([("small", 499, 118), ("large", 499, 145), ("none", 1, 1)], "model_id STRING, input_tokens BIGINT, output_tokens BIGINT")
    )
    costs = [r["cost_usd"] for r in priced.collect()]
    assert costs[:2] == pytest.approx([0.00027225, 0.003672]) and costs[2] is None


def test_infer_keeps_going_when_a_batch_fails(spark):
    def model(batches):
        for batch in batches:
            if (batch["prompt"] == "bad").any():
                raise RuntimeError("model refused")
            yield pd.DataFrame({"raw_output": batch["prompt"].str.upper(), "input_tokens": 1, "output_tokens": 2, "latency_seconds": 0.5})

    rows = spark.createDataFrame(
        [(f"d{i}", "m", "t", "s", "bad" if i == 3 else "ok") for i in range(6)],
        "document_id STRING, model_id STRING, task STRING, system STRING, prompt STRING",
    )
    got = {r["document_id"]: r for r in prompts.infer(rows.repartition(6, "document_id"), model).collect()}
    assert len(got) == 6 and got["d3"]["raw_output"] is None and "model refused" in got["d3"]["error"]
    assert got["d0"]["error"] is not None or got["d0"]["raw_output"] == "OK"
    assert any(r["raw_output"] == "OK" and r["error"] is None for r in got.values())


def test_infer_frees_each_batch(spark):
    """A call that ties its batch into a reference cycle, as ``.str`` does, keeps no batch but the current one."""
    born, alive = [], []

    def model(batches):
        for batch in batches:
            born.append(weakref.ref(batch["prompt"]))
            yield pd.DataFrame({"raw_output": batch["prompt"].str.upper(), "input_tokens": 1, "output_tokens": 2, "latency_seconds": 0.5})

    class Requests:
        """Hands back the function that Spark would run."""

        def mapInPandas(self, fn, schema):
            return fn

    rows = (pd.DataFrame({"document_id": ["d"], "model_id": "m", "task": "t", "system": "s", "prompt": "p"}) for _ in range(8))
    gc.disable()
    try:
        for answer in prompts.infer(Requests(), model)(rows):
            assert answer["raw_output"].tolist() == ["P"]
            alive.append(sum(ref() is not None for ref in born))
    finally:
        gc.enable()
    assert len(alive) == 8 and max(alive) <= 2


def test_answers_and_their_absence(spark):
    asked = spark.createDataFrame([(d, "m", "t") for d in "abc"], "document_id STRING, model_id STRING, task STRING")
    answers = spark.createDataFrame(
        [("a", "m", "t", "{}", None), ("b", "m", "t", None, "timeout"), ("c", "other", "t", "{}", None)],
        "document_id STRING, model_id STRING, task STRING, raw_output STRING, error STRING",
    )
    got = {r["document_id"]: r["run_error"] for r in prompts.join_responses(asked, answers).collect()}
    assert got == {"a": None, "b": C.MSG_FAILED, "c": C.MSG_FAILED}


@pytest.mark.parametrize(
    "amount, shown",
    [("0", "0"), ("999", "999"), ("1000", "1,000"), ("145000", "1,45,000"), ("12345678", "1,23,45,678"), ("-145000.5", "-1,45,000.5"),
     ("1234.5678", "1,234.568"), ("100.00", "100"), ("10", "10"), ("1000000000", "1,00,00,00,000"), ("0.25", "0.25")],
)
def test_indian_grouping(spark, amount, shown):
    assert spark.range(1).select(format_inr(F.lit(amount).cast("decimal(20,6)"))).first()[0] == shown


def test_media_and_codes(spark):
    keys = ["a.PNG", "My_Invoice.jpeg", "b.txt", "c.jpg.txt", "claim_car.txt", "claim_claim_x.txt.txt.png"]
    rows = spark.createDataFrame([(k,) for k in keys], "k STRING")
    got = [tuple(r) for r in rows.select(media_of(F.col("k")), clean_code(F.col("k"))).collect()]
    assert [g[0] for g in got] == ["photo", "invoice", "text", "text", "text", "photo"]
    assert got[4][1] == "CAR" and got[5][1] == "CLAIM_X.TXT"


RULE_CASES = [
    ("auto", 50000.0, "2026-05-14", "2026-06-13", []),
    ("auto", 50000.01, "2026-05-14", "2026-06-14", ["AUTO_POLICE_REPORT", "AUTO_LATE_FILING"]),
    ("auto", 200000.0, "not a date", "2026-06-14", ["AUTO_SCRUTINY", "AUTO_POLICE_REPORT"]),
    ("property", 100000.0, None, None, []),
    ("property", 500000.01, None, None, ["PROP_OVER_CAP", "PROP_VERIFICATION"]),
    ("health", 1.0, None, None, ["HLTH_DOCUMENTS"]),
    ("other", 9e9, None, None, []),
    ("auto", None, None, None, []),
]


def test_coverage_rules(spark):
    rows = spark.createDataFrame(
        [(i, *case[:4]) for i, case in enumerate(RULE_CASES)],
        "i INT, claim_type STRING, claim_amount DOUBLE, incident_date STRING, filed STRING",
    )
    got = {r["i"]: r["rule_codes"] for r in coverage.evaluate_coverage_rules(rows, filed_date="filed").collect()}
    assert got == {i: case[4] for i, case in enumerate(RULE_CASES)}


def test_form_path_end_to_end(docs):
    got = {r["document_id"]: r for r in jobs.process_forms(docs, now=7).collect()}
    row = got["claim_car.txt"]
    assert row["status"] == "success" and row["validation_warnings"] == [] and row["injection_flags"] == []
    assert float(row["extracted_info"]["claim_amount"]) == 145000 and row["processed_timestamp"] == 7
    assert row["summary"].startswith("Rajesh Kumar Menon claims INR 1,45,000 for an incident on 2026-05-14. A lorry rolled")
    assert row["summary"].endswith(
        "Policy: Auto Policy Coverage Summary — Tamil Nadu Standard Motor Plan. Check: police report required."
    )


def test_grounding(spark):
    rows = spark.createDataFrame(
        [("Claims 1,45,000 of 200000 on 2026", "limit INR 200,000", "Amount 145000"), ("none", "5", None), ("Over 7.5", None, None)],
        "s STRING, a STRING, b STRING",
    )
    got = [(r["ungrounded"], r["is_grounded"]) for r in coverage.grounding_check(rows, "s", ["a", "b"]).collect()]
    assert got == [(["2026"], False), ([], True), (["7.5"], False)]


def test_figures(spark):
    got = spark.range(1).select(figures(F.lit("INR 5,00,000 and 92500. 3-day 1.25"))).first()[0]
    assert got == ["500000", "92500", "3", "1.25"]


def test_each_reading_of_the_form_is_made_once(spark):
    """Four labels and the description are searched once each, however often their values are asked for."""
    docs = spark.range(3).selectExpr("concat('Policy Number: AUTO-', id) AS document_text")
    plan = extract.extract_fields(docs, amount_text=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 5
