"""Top-k retrieval, by vector and by terms, against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.functions.vectors import cosine
from claimspark.operators import prompts, retrieve
from claimspark.operators.skew import hot_keys, lookup_join, salted_join
from claimspark.sources.files import chunk_paragraphs

VEC = "file_name STRING, pos INT, embedding ARRAY<FLOAT>"
QUERY = "query_id STRING, embedding ARRAY<FLOAT>"


def brute_topk(corpus, queries, k):
    out = []
    for qid, q in queries:
        q = np.array(q, dtype=np.float32).astype(float)
        scored = []
        for name, pos, v in corpus:
            v = np.array(v, dtype=np.float32).astype(float)
            n = np.linalg.norm(v) * np.linalg.norm(q)
            scored.append((-round(float(v @ q / n) if n else 0.0, 12), name, pos))
        out += [(qid, name, pos, rank + 1) for rank, (_, name, pos) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    corpus = [(f"f{i % 7}", i, rng.normal(size=8).tolist()) for i in range(300)]
    corpus += [("copy", i, corpus[5][2]) for i in range(120)]  # copies tie exactly
    corpus += [("zero", i, [0.0] * 8) for i in range(5)]
    queries = [(f"q{i}", rng.normal(size=8).tolist()) for i in range(6)] + [("same", corpus[5][2]), ("null", [0.0] * 8)]
    return corpus, queries


@pytest.mark.parametrize("k, block", [(1, 512), (2, 512), (5, 3), (1000, 2)])
def test_similarity_equals_brute_force(spark, vectors, k, block):
    corpus, queries = vectors
    got = retrieve.similarity_topk(
        spark.createDataFrame(corpus, VEC).repartition(5), spark.createDataFrame(queries, QUERY), k=k, block=block
    )
    assert sorted((r["query_id"], r["file_name"], r["pos"], r["rank"]) for r in got.collect()) == brute_topk(corpus, queries, k)


def test_odd_vectors_take_no_part(spark, vectors):
    corpus, queries = vectors
    odd = [("odd", 1, None), ("odd", 2, [1.0] * 7), ("odd", 3, [None] * 8), ("odd", 4, [])]
    got = retrieve.similarity_topk(
        spark.createDataFrame(corpus + odd, VEC), spark.createDataFrame(queries + [("bad", None), ("short", [1.0])], QUERY), k=2
    )
    assert sorted((r["query_id"], r["file_name"], r["pos"], r["rank"]) for r in got.collect()) == brute_topk(corpus, queries, 2)


def test_thousands_of_queries_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    many = [(f"q{i:05d}", rng.normal(size=8).tolist()) for i in range(3000)]
    corpus = [("f", i, v) for i, (_, v) in enumerate(many[:400])]
    got = retrieve.similarity_topk(spark.createDataFrame(corpus, VEC), spark.createDataFrame(many, QUERY), k=1, block=100).collect()
    assert len(got) == 3000 and all(r["similarity"] == pytest.approx(1.0) for r in got if int(r["query_id"][1:]) < 400)


def test_no_queries_no_rows(spark, vectors):
    got = retrieve.similarity_topk(spark.createDataFrame(vectors[0], VEC), spark.createDataFrame([], QUERY))
    assert got.count() == 0 and "rank" in got.columns


def test_cosine_column_and_norms(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.96, 0.0])
    assert [r["vector_norm"] for r in retrieve.vector_norms(rows, "a").collect()] == [5.0, 0.0]


POLICIES = [
    ("auto.txt", "Auto Plan\n\nAuto claim coverage limits, claim limits.\n\n  \n\nNothing here."),
    ("health.txt", "Health Plan\n\nHealth claim: exclusions and coverage."),
    ("zero.txt", "...\n\n!!"),
]


def test_chunks(spark):
    rows = chunk_paragraphs(spark.createDataFrame(POLICIES, "file_name STRING, text STRING"))
    assert [tuple(r) for r in rows.where("file_name = 'auto.txt'").orderBy("pos").collect()] == [
        ("auto.txt", 0, "Auto Plan"), ("auto.txt", 1, "Auto claim coverage limits, claim limits."), ("auto.txt", 2, "Nothing here."),
    ]
    assert tuple(retrieve.chunk_stats(rows).first()) == (7, 3)
    with pytest.raises(Exception, match="No policy documents found"):
        retrieve.chunk_stats(rows.where("false")).collect()


def brute_tfidf(chunks, queries, k):
    def weights(text):
        return {t: 1 + math.log(n) for t, n in Counter(re.findall(r"\w+", text.lower())).items()}

    docs = {key: w for key, text in chunks.items() if (w := weights(text))}
    df = Counter(t for w in docs.values() for t in w)
    out = []
    for qid, text in queries.items():
        q = {t: w * math.log(1 + len(docs) / df[t]) for t, w in weights(text).items() if df[t]}
        qn = math.sqrt(sum(w * w for w in q.values()))
        scored = []
        for key, w in docs.items():
            if set(w) & set(q):
                s = sum(w[t] * q[t] for t in set(w) & set(q)) / (qn * math.sqrt(sum(x * x for x in w.values())))
                scored.append((-round(s, 9), key))
        out += [(qid, *key, rank + 1, pytest.approx(-s, abs=1e-8)) for rank, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: (r[0], r[3]))


def test_tfidf_equals_brute_force(spark):
    chunks = chunk_paragraphs(spark.createDataFrame(POLICIES, "file_name STRING, text STRING"))
    types = spark.createDataFrame([("auto",), ("health",), (None,)], "claim_type STRING")
    queries = prompts.retrieval_query(types).withColumn("query_id", F.coalesce("claim_type", F.lit("other")))
    texts = {r["query_id"]: r["query_text"] for r in queries.collect()}
    assert texts["other"] == "other claim coverage limits and exclusions"
    plain = {(r["file_name"], r["pos"]): r["chunk"] for r in chunks.collect()}
    got = retrieve.tfidf_retrieve(chunks, queries, k=3)
    rows = [(r["query_id"], r["file_name"], r["pos"], r["rank"], r["similarity"]) for r in got.orderBy("query_id", "rank").collect()]
    assert rows == brute_tfidf(plain, texts, 3)


def test_contexts_best_first(spark):
    chunks = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")], "file_name STRING, pos INT, chunk STRING")
    topk = spark.createDataFrame([("auto", "b", 0, 1), ("auto", "a", 1, 2), ("other", "a", 0, 1)], "query_id STRING, file_name STRING, pos INT, rank INT")
    contexts = retrieve.policy_context(topk, chunks)
    assert {r["query_id"]: r["context"] for r in contexts.collect()} == {"auto": "three\n---\ntwo", "other": "one"}
    claims = spark.createDataFrame([("d1", "auto"), ("d2", None), ("d3", "marine"), ("d4", "auto")], "document_id STRING, claim_type STRING")
    for rows_per_slice in (None, 1):
        got = {r["document_id"]: r["context"] for r in retrieve.attach_context(claims, contexts, rows_per_slice).collect()}
        assert got == {"d1": "three\n---\ntwo", "d2": "one", "d3": None, "d4": "three\n---\ntwo"}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 11}") for i in range(200)] + [(900, None)], "id INT, k STRING")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k3", 4), ("none", 5)], "k STRING, v INT")
    counts = left.groupBy("k").count()
    hot = hot_keys(counts, "k", "count", rows_per_slice=20)
    assert hot.collect()[0]["_hot"] == "hot" and hot.collect()[0]["_slices"] > 1

    def rows(df):
        return sorted(map(str, df.collect()))

    want = rows(left.join(right, "k", how))
    assert rows(salted_join(left, right, "k", F.col("id"), hot, how)) == want
    assert rows(lookup_join(left, right, "k", F.col("id"), how)) == want
    assert rows(lookup_join(left, right, "k", F.col("id"), how, rows=2, rows_per_slice=20)) == want
