"""Files, events, uploads, result tables, streams."""

import json

import pytest
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.operators import compare, results
from claimspark.plans import claims as jobs
from claimspark.session import fresh_path, materialise, work_dir
from claimspark.sources import events, files, sinks
from claimspark.streaming.claims import LIST_TASKS, LISTING, stream_claims, upsert_to

from test_extract import AUTO, DOCS, HEALTH


@pytest.fixture
def folder(tmp_path):
    for name, text in DOCS:
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "scan_invoice.PNG").write_bytes(b"\x89PNG")
    (tmp_path / "photo.jpg").write_bytes(b"\xff\xd8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "inner.txt").write_text("inner")
    (tmp_path / "sub" / "claim_car.txt").write_text("another")
    (tmp_path / "k=0012").mkdir()
    (tmp_path / "k=0012" / "a+b c%é").write_text("no extension")
    (tmp_path / "U.TXT").write_text("upper")
    (tmp_path / "b.md").write_text("notes")
    return tmp_path


OTHERS = {"sub/inner.txt": "inner", "sub/claim_car.txt": "another", "k=0012/a+b c%é": "no extension", "U.TXT": "upper", "b.md": "notes"}


def test_list_and_scan(spark, folder):
    every = {**dict(DOCS), **OTHERS}
    listed = [r["document_id"] for r in files.list_documents(spark, str(folder)).collect()]
    assert listed == sorted([*every, "photo.jpg", "scan_invoice.PNG"])
    scanned = {r["document_id"]: (r["document_text"], r["media"]) for r in files.scan_documents(spark, str(folder)).collect()}
    assert scanned == {name: (text, "text") for name, text in every.items()}
    images = {r["document_id"]: (r["media"], bytes(r["content"])) for r in files.scan_images(spark, str(folder)).collect()}
    assert images == {"scan_invoice.PNG": ("invoice", b"\x89PNG"), "photo.jpg": ("photo", b"\xff\xd8")}
    assert [r["document_id"] for r in files.list_documents(spark, str(folder), "*.md").collect()] == ["b.md"]


def test_files_are_landed_under_their_keys(spark, tmp_path):
    rows = [(name, text) for name, text in OTHERS.items()]
    assert sinks.write_files(spark.createDataFrame(rows, "k STRING, t STRING"), str(tmp_path / "x"), "k", "t") == len(rows)
    assert {r["document_id"]: r["document_text"] for r in files.scan_documents(spark, str(tmp_path / "x")).collect()} == OTHERS


def test_scan_folds_newlines_and_keeps_one_row_per_file(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\n\r\ny\rz é".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r["document_id"]: r["document_text"] for r in files.scan_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "x\n\ny\nz é" and got.get("b.txt", "") == ""


def test_scan_policies_is_not_recursive(spark, folder):
    names = {r["file_name"] for r in files.scan_policies(spark, str(folder)).collect()}
    assert "inner.txt" not in names and DOCS[0][0] in names


def test_fallback(spark):
    primary = spark.createDataFrame([("a", "p")], "document_id STRING, document_text STRING")
    fallback = spark.createDataFrame([("a", "f"), ("b", "f")], "document_id STRING, document_text STRING")
    got = {r[0]: r[1] for r in files.source_with_fallback(primary, fallback).collect()}
    assert got == {"a": "p", "b": "f"}
    assert files.source_with_fallback(primary.where("false"), fallback).count() == 2


def test_upload_admission(spark):
    names = ["claim 1.txt", "../../etc/x.txt", "A.PNG", "a.png", "", None, "....jpg", "b.pdf", "é.txt"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, file_name STRING")
    got = {r["i"]: (r["document_id"], r["reject_reason"]) for r in files.admit_uploads(rows).collect()}
    assert got == {
        0: ("claim_1.txt", None), 1: ("etc_x.txt", None), 2: (None, "File type not allowed"), 3: ("a.png", None),
        4: (None, "Empty filename"), 5: (None, "Empty filename"), 6: ("jpg", None), 7: (None, "File type not allowed"), 8: ("txt", None),
    }


def test_events(spark):
    payloads = [
        {"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "k1"}}}, {"s3": {"object": {"key": "no"}}}]},
        {"bucket": "b", "key": "k2"},
        {"bucket": "b"},
        {"bucket": "b", "key": ""},
        {"Records": [], "key": "flat is not used"},
    ]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(9, "not json")], "i INT, payload STRING")
    got = {r["i"]: (r["bucket"], r["document_id"], r["run_error"]) for r in events.normalise_events(rows).collect()}
    assert got == {
        0: ("b", "k1", None), 1: ("b", "k2", None), 2: ("b", None, C.MSG_NO_KEY), 3: ("b", None, C.MSG_NO_KEY),
        4: (None, None, C.MSG_NO_KEY), 9: (None, None, C.MSG_NO_KEY),
    }


def test_event_filter(spark):
    def event(source="aws.s3", kind="Object Created", bucket="inbox"):
        return json.dumps({"source": source, "detail-type": kind, "detail": {"bucket": {"name": bucket}, "object": {"key": "k"}}})

    rows = spark.createDataFrame([(event(),), (event(source="x"),), (event(kind="Object Deleted"),), (event(bucket="other"),), ("{}",)], "payload STRING")
    assert [tuple(r)[1:] for r in events.filter_events(rows, bucket=["inbox"]).collect()] == [("inbox", "k")]
    assert events.filter_events(rows).count() == 2


def test_result_table_is_replay_safe(spark):
    path = fresh_path(spark, "results")
    docs = spark.createDataFrame(DOCS, "document_id STRING, document_text STRING")
    for batch, now in ((0, 10), (1, 20), (1, 20)):
        sinks.write_results(jobs.process_forms(docs, now=now), path, batch)
    stored = sinks.stored_results(spark, path)
    assert stored.count() == 6
    latest = results.latest_results(stored)
    assert {(r["document_id"], r["processed_timestamp"], r["batch_id"]) for r in latest.collect()} == {(n, 20, 1) for n, _ in DOCS}
    # a batch that now ends in another status leaves nothing of its first run behind
    sinks.write_results(jobs.process_forms(docs.limit(1), now=30).withColumn("status", F.lit("pipeline_failure")), path, 1)
    assert sinks.stored_results(spark, path).where("batch_id = 1").count() == 1


def test_another_run_overwrites_nothing(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "document_id STRING, document_text STRING")
    path = str(tmp_path / "t")
    sinks.write_results(jobs.process_forms(docs, now=1), path, 0)
    sinks.write_results(jobs.process_forms(docs.limit(1), now=2), path, 0, run_id="other")
    stored = sinks.stored_results(spark, path)
    assert stored.count() == len(DOCS) + 1
    sinks.compact_results(stored, str(tmp_path / "next"))
    small = sinks.stored_results(spark, str(tmp_path / "next"))
    assert small.count() == len(DOCS) and sinks.stored_results(spark, path).count() == len(DOCS) + 1
    assert {(r["processed_timestamp"], r["run_id"]) for r in small.collect()} == {(1, "batch"), (2, "other")}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.compact_results(stored, str(tmp_path / "next"))


def test_a_retried_answer_counts_once(spark):
    from claimspark.operators.prompts import join_responses

    asked = spark.createDataFrame([("d", "m", "t", None), ("e", "m", "t", "lost before")], "document_id STRING, model_id STRING, task STRING, run_error STRING")
    answers = spark.createDataFrame(
        [("d", "m", "t", None, "timeout"), ("d", "m", "t", "x", None), ("d", "m", "t", "x", None), ("d", "m", "t", "a", None), ("e", "m", "t", "y", None)],
        "document_id STRING, model_id STRING, task STRING, raw_output STRING, error STRING",
    )
    got = {r["document_id"]: (r["raw_output"], r["run_error"]) for r in join_responses(asked, answers).collect()}
    assert got == {"d": ("x", None), "e": ("y", "lost before")} and join_responses(asked, answers).count() == 2


def test_each_status_keeps_its_columns(spark):
    docs = spark.createDataFrame([(k, AUTO) for k in "abc"], "document_id STRING, document_text STRING")
    answers = spark.createDataFrame(
        [("a", "m", "extract_info", json.dumps(dict(zip(C.REQUIRED_FIELDS, ["n", "p", "d", 5, "x", "auto"]))), 0.9), ("b", "m", "extract_info", "sorry", 0.8)],
        "document_id STRING, model_id STRING, task STRING, raw_output STRING, latency_seconds DOUBLE",
    )
    summaries = spark.createDataFrame(
        [("a", "s", "generate_summary", "short", 2.0)],
        "document_id STRING, model_id STRING, task STRING, raw_output STRING, latency_seconds DOUBLE",
    )
    judged = jobs.judged_claims(docs, answers, "m")
    rows = {r["document_id"]: r for r in jobs.finish_claims(judged, summaries, "s", now=1).collect()}
    assert rows["a"]["status"] == "success" and rows["a"]["summary"] == "short"
    assert rows["a"]["metrics"].asDict() == {
        "extraction_latency_s": 0.9, "summary_latency_s": 2.0, "extraction_model": "m", "summary_model": "s",
    }
    assert rows["b"]["status"] == "extraction_failed" and rows["b"]["raw_output"] == "sorry"
    assert json.loads(rows["b"]["errors"]) == [C.MSG_NOT_JSON] and rows["b"]["metrics"] is None
    assert rows["c"]["status"] == "pipeline_failure" and rows["c"]["error"] == C.MSG_FAILED
    lost = {r["document_id"]: r["status"] for r in jobs.finish_claims(judged, summaries.where("false"), "s", now=1).collect()}
    assert lost == {"a": "pipeline_failure", "b": "extraction_failed", "c": "pipeline_failure"}
    contexts = spark.createDataFrame([("auto", "CTX")], "query_id STRING, context STRING")
    asked = jobs.summary_requests(judged, contexts, "s").collect()
    assert [r["document_id"] for r in asked] == ["a"] and "CTX" in asked[0]["prompt"] and '"claimant_name":"n"' in asked[0]["prompt"]


def test_stored_wins_over_computed(spark):
    docs = spark.createDataFrame(DOCS, "document_id STRING, document_text STRING")
    path = fresh_path(spark, "results")
    sinks.write_results(jobs.process_forms(docs.where("document_id = 'claim_car.txt'"), now=1), path, 0)
    stored = results.latest_results(sinks.stored_results(spark, path))
    got = results.stored_or_computed(docs, stored, lambda missing: jobs.process_forms(missing, now=2))
    assert {r["document_id"]: (r["source"], r["processed_timestamp"]) for r in got.collect()} == {
        "claim_car.txt": ("stored", 1), "claim_care.txt": ("computed", 2), "claim_home.txt": ("computed", 2),
    }
    keys = spark.createDataFrame([("claim_car.txt",), ("absent",), ("claim_car.txt",)], "document_id STRING")
    assert results.lookup_results(stored, keys).count() == 1
    listing = {r["document_id"]: (r["badge"], r["code"], r["icon_type"]) for r in results.claim_listing(docs, stored).collect()}
    assert listing["claim_car.txt"] == ("Processed", "CAR", "Doc")
    assert listing["claim_care.txt"][0] == "Unprocessed"
    back = results.read_results(stored).first()
    assert back["extracted_info"]["claim_amount"] == 145000.0 and back["validation_warnings"] == []


def test_defaults_and_metrics(spark):
    rows = spark.createDataFrame(
        [(None, "", "2026", float("nan"), None, 0.92, 2.17), ("n", "p", None, 5.0, "auto", 0.99, 2.56), ("n", "p", "d", None, "health", 1.0, 1.0)],
        "claimant_name STRING, policy_number STRING, incident_date STRING, claim_amount DOUBLE, claim_type STRING, "
        "extraction_latency_s DOUBLE, summary_latency_s DOUBLE",
    )
    filled = [tuple(r)[:5] for r in results.default_fields(rows).collect()]
    assert filled == [("", "", "2026", 0.0, "auto"), ("n", "p", "", 5.0, "auto"), ("n", "p", "d", 0.0, "health")]
    assert [(r["total_latency_s"], r["cost_per_claim_usd"]) for r in results.claim_metrics(rows, {"auto": 0.1}, other=0.2).collect()] == [
        (3.09, 0.2), (3.55, 0.1), (2.0, 0.2),
    ]


def test_json_export(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "document_id STRING, document_text STRING")
    sinks.export_results_json(jobs.process_forms(docs, now=1), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["document_id"]: x["extracted_info"]["claim_type"] for x in lines} == {
        "claim_car.txt": "auto", "claim_care.txt": "health", "claim_home.txt": "property",
    }


def test_comparison(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "document_id STRING")
    with pytest.raises(ValueError, match="at least two"):
        compare.compare_requests(docs, ["a", "a", ""])
    asked = compare.compare_requests(docs, ["small", "large"])
    assert asked.count() == 4
    good = json.dumps(dict(zip(C.REQUIRED_FIELDS, ["n", "p", "d", 5, "x", "auto"])))
    answers = spark.createDataFrame(
        [("d1", "small", good, 0.9, 499, 118), ("d2", "small", f"```json\n{good}\n```", 1.0, 499, 118),
         ("d1", "large", good.replace('"n"', '""'), 2.3, 499, 145)],
        "document_id STRING, model_id STRING, raw_output STRING, latency_seconds DOUBLE, input_tokens BIGINT, output_tokens BIGINT",
    ).withColumn("task", F.lit("extract_info"))
    rows = compare.compare_models(asked, answers)
    got = {(r["document_id"], r["model"]): (r["valid_json"], r["warnings"], r["first_try_json"], r["all_fields"]) for r in rows.collect()}
    assert got[("d1", "small")] == (True, 0, True, True)
    assert got[("d2", "small")] == (True, 0, False, True)
    assert got[("d1", "large")] == (True, 1, True, False)
    assert got[("d2", "large")][0] is False
    summary, accuracy = compare.model_summary(rows), compare.extraction_accuracy(rows)
    cost = {r["model"]: r["cost_per_1000_usd"] for r in summary.collect()}
    assert cost == {"small": pytest.approx(0.27225), "large": pytest.approx(3.672)}
    assert compare.pick_model(summary, accuracy).first()["model"] == "small"


def test_stream_upsert_routing_and_redelivery(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.txt").write_text(AUTO)
    (inbox / "b.txt").write_text("no form at all")
    (inbox / "c.png").write_bytes(b"image")
    clock = iter(range(100, 200))

    def process(batch):
        return jobs.process_forms(batch, now=next(clock))

    def run():
        stream_claims(spark, str(inbox), out, state, process).awaitTermination()
        stored = sinks.stored_results(spark, out)
        return stored, {r["document_id"]: r for r in results.latest_results(stored).collect()}

    stored, rows = run()
    assert set(rows) == {"a.txt", "b.txt", "c.png"} and rows["a.txt"]["extracted_info"]["claim_type"] == "auto"
    assert rows["c.png"]["status"] == "pipeline_failure"
    # nothing new: nothing written again
    assert run()[0].count() == 3
    # equal base names are two documents
    (inbox / "later").mkdir()
    (inbox / "later" / "a.txt").write_text(AUTO)
    stored, latest = run()
    assert latest["later/a.txt"]["status"] == "success" and stored.count() == 4
    # a stream with a new checkpoint is another run: it adds rows, removes none, and the newer ones win
    (inbox / "a.txt").write_text(HEALTH)
    stream_claims(spark, str(inbox), out, state + "-2", process).awaitTermination()
    stored = sinks.stored_results(spark, out)
    latest = {r["document_id"]: r for r in results.latest_results(stored).collect()}
    assert stored.count() == 8 and latest["a.txt"]["extracted_info"]["claim_type"] == "health"


def test_batch_replay_overwrites_itself(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "document_id STRING, document_text STRING")
    write = upsert_to(str(tmp_path / "t"), lambda batch: jobs.process_forms(batch, now=5))
    write(docs, 3)
    write(docs, 3)
    assert sinks.stored_results(spark, str(tmp_path / "t")).count() == 3


def test_shared_folder_comes_from_the_session(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = materialise(spark.range(5), "five")
    assert kept.count() == 5 and work_dir(spark) in kept.inputFiles()[0]


def test_stream_lists_many_files_by_few_tasks(spark, tmp_path):
    """A batch of files is looked up by a bounded number of tasks, not by one for each file."""
    spark.conf.set(LISTING, "10000")
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3 * LIST_TASKS):
        (inbox / f"claim {i}.txt").write_text(DOCS[0][1], encoding="utf-8")
    stored = fresh_path(spark, "results")
    stream = stream_claims(spark, str(inbox), stored, fresh_path(spark, "state"), lambda batch: jobs.process_forms(batch, now=1))
    stream.awaitTermination()
    assert sinks.stored_results(spark, stored).count() == 3 * LIST_TASKS
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(str(stream.runId)) for s in tracker.getJobInfo(job).stageIds]
    assert 0 < max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) <= LIST_TASKS
