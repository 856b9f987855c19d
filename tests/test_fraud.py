"""Containment matching and the fraud check, against brute force."""

import gc
import random
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.operators import fraud, matching, skew
from claimspark.operators.fraud import fraud_band, fraud_index, fraud_matches, fraud_reasons, fraud_score, reasons_for

CLAIM = "document_id STRING, claimant_name STRING, policy_number STRING"
TEXT = "document_id STRING, document_text STRING"


def brute_hits(needles, texts):
    return {(d, n) for d, t in texts for n in needles if n and t is not None and n in t.lower()}


def needle_frame(spark, needles):
    return spark.createDataFrame([(n,) for n in sorted(needles)], "needle STRING")


def found(spark, needles, texts, slices=4):
    """Containments found, after the equality with the needles that every user of the hits does."""
    frame = spark.createDataFrame(texts, TEXT).repartition(slices)
    hits = matching.needle_hits(needle_frame(spark, needles), frame, "document_id", "document_text")
    return [(r[0], r[1]) for r in hits.collect() if r[1] in needles]


def test_matches_equal_brute_force(spark):
    random.seed(3)
    alphabet = "abAB é漢-0"
    texts = [(f"d{i}", "".join(random.choices(alphabet, k=random.randint(0, 200)))) for i in range(150)]
    needles = {"".join(random.choices(alphabet.lower(), k=random.randint(1, 7))) for _ in range(300)}
    texts += [("none", None), ("empty", ""), ("whole", next(iter(needles)))]
    got = found(spark, needles, texts)
    assert len(got) == len(set(got))
    assert set(got) == brute_hits(needles, texts)


def test_needles_in_groups(spark, monkeypatch):
    """More needles than one bitmap holds: each group has a bitmap of its own, and lets little else through."""
    monkeypatch.setattr(matching, "MIN_BITS", 64 * 1000)
    monkeypatch.setattr(matching, "MAX_BITS", 64 * 1024)
    monkeypatch.setattr(matching, "BATCH_BYTES", 500)
    needles = {f"name{i:05d} of" for i in range(3500)}
    texts = [(f"d{i}", f"claim of name{i % 4000:05d} of town, not name9{i:04d} of") for i in range(0, 4000, 7)]
    hits = matching.needle_hits(needle_frame(spark, needles), spark.createDataFrame(texts, TEXT), "document_id", "document_text").collect()
    true = brute_hits(needles, texts)
    assert {(d, n) for d, n in hits if n in needles} == true and len(hits) <= 2 * len(true)


def test_cut_batches_are_freed_at_once(monkeypatch):
    """Cuts fall where the running size passes the limit, and no batch waits for Python to look for cycles."""
    monkeypatch.setattr(matching, "BATCH_BYTES", 10)
    born = []

    def batches():
        for i in range(6):
            batch = pd.DataFrame({"t": ["x" * 9, None, "y" * 9, "", "z"] if i % 2 else ["one"]})
            born.append(weakref.ref(batch["t"]))
            yield batch
            del batch
        yield pd.DataFrame({"t": pd.Series([], dtype=object)})

    gc.disable()
    try:
        sizes = [len(part) for part in matching._by_bytes(batches(), "t")]
        assert sum(ref() is not None for ref in born) == 0
    finally:
        gc.enable()
    assert sizes == [1, 2, 3] * 3


def test_windows_across_blocks_and_documents(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_BYTES", 16)
    random.seed(5)
    texts = [(f"d{i}", "".join(random.choices("ab", k=random.randint(0, 90)))) for i in range(60)]
    needles = {"".join(random.choices("ab", k=random.randint(1, 20))) for _ in range(80)}
    assert set(found(spark, needles, texts, slices=1)) == brute_hits(needles, texts)


def test_needles_of_all_lengths_cut_from_the_texts(spark):
    random.seed(9)
    texts = [(f"d{i}", "".join(random.choices("abcé ", k=150))) for i in range(40)]
    needles = set()
    for length in range(1, 130):
        _, text = random.choice(texts)
        at = random.randrange(len(text) - length + 1)
        needles |= {text[at : at + length], text[at : at + length - 1] + "z"}
    got = set(found(spark, needles, texts))
    assert got == brute_hits(needles, texts) and any(len(n) > 100 for _, n in got)


def sample(spark):
    """Claims and texts with shared names, substring policies, hollow needles, case variants."""
    claims = [
        ("c1", "Asha Rao", "AUTO-TN-8821"),
        ("c2", "ASHA RAO", "AUTO-TN-88213"),
        ("c3", "Bala", "HLTH-TN-1"),
        ("c4", None, "PROP-TN-5"),
        ("c5", "", ""),
        ("c6", "Chitra", "PROP-TN-5"),
        ("c7", "Nobody Else", "MISC-TN-9"),
    ]
    texts = [
        ("c1", "claim of asha rao, AUTO-TN-8821"),
        ("c2", "claim of Asha Rao, auto-tn-88213, refers to Bala"),
        ("c3", "no identifiers at all"),
        ("c4", "PROP-TN-5 and chitra"),
        ("c5", ""),
        ("c6", "prop-tn-5 chitra"),
        ("c7", "Nobody Else MISC-TN-9"),
        ("x8", "BALA and HLTH-TN-1"),
    ]
    return claims, texts, spark.createDataFrame(claims, CLAIM), spark.createDataFrame(texts, TEXT)


def brute_scores(claims, texts):
    out = {}
    for key, name, policy in claims:
        others = [t.lower() for d, t in texts if d != key]
        names = sum(bool(name) and name.lower() in t for t in others)
        policies = sum(bool(policy) and policy.lower() in t for t in others)
        out[key] = (names, policies, min(100, 45 * names + 50 * policies))
    return out


#: who is found where in the sample: (document, other document, text of the identifier, kind)
SAMPLE_REASONS = [
    ("c1", "c2", "Matching claimant 'Asha Rao' found in file 'c2'"),
    ("c1", "c2", "Matching policy number 'AUTO-TN-8821' found in file 'c2'"),
    ("c2", "c1", "Matching claimant 'ASHA RAO' found in file 'c1'"),
    ("c3", "c2", "Matching claimant 'Bala' found in file 'c2'"),
    ("c3", "x8", "Matching claimant 'Bala' found in file 'x8'"),
    ("c3", "x8", "Matching policy number 'HLTH-TN-1' found in file 'x8'"),
    ("c4", "c6", "Matching policy number 'PROP-TN-5' found in file 'c6'"),
    ("c6", "c4", "Matching claimant 'Chitra' found in file 'c4'"),
    ("c6", "c4", "Matching policy number 'PROP-TN-5' found in file 'c4'"),
]


@pytest.mark.parametrize("rows_per_slice", [1, 1_000_000])
def test_scores_and_reasons(spark, rows_per_slice):
    claims, texts, claim_df, text_df = sample(spark)
    index = fraud_index(claim_df, text_df)
    got = {r[0]: tuple(r[1:]) for r in fraud_score(claim_df, index, rows_per_slice).collect()}
    assert got == brute_scores(claims, texts)
    matches = fraud_matches(claim_df, index, rows_per_slice)
    pairs = reasons_for(claim_df, matches, rows_per_slice).orderBy("document_id", "other_id", "ord")
    assert [(r["document_id"], r["other_id"], r["reason"]) for r in pairs.collect()] == SAMPLE_REASONS


def test_reasons_in_report_order(spark):
    """Sorted before the texts are made: documents that are checked twice, one without a key, marks inside identifiers."""
    random.seed(4)
    claims = [(f"c{random.randrange(40):03d}", f"Name|{random.randrange(9)}", f"P-{random.randrange(30)}|") for _ in range(60)]
    claims += [(None, "Name|1", "P-1|")]
    texts = [(f"c{i:03d}", " ".join(f"{n} {p}" for _, n, p in random.sample(claims, 2))) for i in range(50)]
    claim_df, text_df = spark.createDataFrame(claims, CLAIM), spark.createDataFrame(texts, TEXT)
    matches = fraud_matches(claim_df, fraud_index(claim_df, text_df))
    expected = sorted(
        (key, d, kind, f"Matching {('claimant', 'policy number')[kind]} '{name}' found in file '{d}'")
        for key, *names in claims for kind, name in enumerate(names) for d, t in texts
        if key is not None and d != key and name.lower() in t.lower()
    )
    for rows_per_slice in (3, 1_000_000):
        got = [tuple(r) for r in reasons_for(claim_df, matches, rows_per_slice, in_order=True).collect()]
        assert [r[:3] for r in got] == [r[:3] for r in expected] and sorted(got) == expected


def test_joins_without_a_hot_key_are_plain(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x long")
    right = spark.createDataFrame([("a", 5)], "k string, y long")
    hot = skew.hot_keys(left.groupBy("k").count(), "k", "count", 1)
    joined = skew.salted_join(left, right, "k", F.col("x"), hot)
    assert joined.columns == ["k", "x", "y"] and {tuple(r) for r in joined.collect()} == {("a", 1, 5), (None, 2, None)}
    assert "_slice" not in joined._jdf.queryExecution().analyzed().toString()


def test_one_needle_owns_most_documents(spark):
    """A third and more of all claims share a name: counts hold, nothing is dropped."""
    claims = [(f"h{i}", "Hot Name", f"P-{i:03d}") for i in range(120)] + [(f"o{i}", f"Name{i}", f"Q-{i:03d}") for i in range(80)]
    texts = [(k, f"{n} {p}") for k, n, p in claims]
    claim_df, text_df = spark.createDataFrame(claims, CLAIM), spark.createDataFrame(texts, TEXT)
    index = fraud_index(claim_df, text_df)
    for rows_per_slice in (7, 1_000_000):
        got = {r[0]: tuple(r[1:]) for r in fraud_score(claim_df, index, rows_per_slice).collect()}
        assert got == brute_scores(claims, texts)
    assert fraud_matches(claim_df, index, 7).count() == 120 + 200 + sum(
        1 for n in range(80) for m in range(80) if n != m and f"name{n}" in f"name{m}"
    ) + 80


def test_score_does_not_depend_on_row_order(spark):
    claims, texts, claim_df, text_df = sample(spark)
    index = fraud_index(claim_df.orderBy("policy_number").repartition(3), text_df.repartition(5))
    got = {r[0]: r[3] for r in fraud_score(claim_df, index).collect()}
    assert got == {k: v[2] for k, v in brute_scores(claims, texts).items()}


def test_bands(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 45, 50, 51, 100)], "risk_score INT")
    got = [(r["risk_band"], r["risk_label"]) for r in fraud_band(rows).orderBy("risk_score").collect()]
    assert got == [
        ("Low", "0% Low Risk"), ("Medium", "45% Medium Risk"), ("Medium", "50% Medium Risk"),
        ("High", "51% High Risk"), ("High", "100% High Risk"),
    ]


def test_reason_texts(spark):
    rows = spark.createDataFrame([("claimant", "A", "d"), ("policy", "P", "d")], "kind STRING, identifier STRING, document_id STRING")
    assert [r["reason"] for r in fraud_reasons(rows).orderBy("kind").collect()] == [
        "Matching claimant 'A' found in file 'd'", "Matching policy number 'P' found in file 'd'",
    ]


def test_no_claims_have_no_needles(spark):
    empty = spark.createDataFrame([("c", None, "")], CLAIM)
    index = fraud.fraud_index(empty, spark.createDataFrame([("c", "text")], TEXT))
    assert index.hits.count() == 0
    assert [tuple(r) for r in fraud_score(empty, index).collect()] == [("c", 0, 0, 0)]
