"""Vector search against brute force, and host reputation on cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm import ann, urls

VEC = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("list", T.StringType()), T.StructField("known", T.IntegerType()), T.StructField("rank", T.IntegerType()),
])


def brute(rows, k, every):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            ranked = sorted((-float((y * x).sum()), i) for i, y in good if i != q)
            out[q] = [(-s, i) for s, i in ranked[:k]]
    return out


@pytest.mark.parametrize(("n", "rows_per_task"), [(8, 4096), (900, 4096), (900, 60)])
def test_search(spark, monkeypatch, n, rows_per_task):
    monkeypatch.setattr(ann, "LIST_ROWS", rows_per_task)
    monkeypatch.setattr(ann, "QUERY_ROWS", rows_per_task)
    rng = np.random.default_rng(n)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.2, 3)).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 3)]      # one vector many times
    rows += [(5000, None), (5010, [0.0] * 16), (5020, [float("nan")] * 16), (5030, [None] * 16), (5040, [1.0] * 15), (5050, []), (None, [1.0] * 16), (5060, [float("inf")] * 16)]
    vectors = spark.createDataFrame([(i, v, "l", 1, 2) for i, v in rows], VEC)
    got = {}
    for r in ann.search(vectors, F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, 20, 10)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, s, i in found] == sorted((-s, i) for _, s, i in found)
        exact = {i: s for s, i in want[q]}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for _, s, i in found if i in exact)
        worst = want[q][-1][0]
        hits += sum(s >= worst - 1e-12 for _, s, _ in found)
        total += len(want[q])
    assert hits / total >= 0.9


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], VEC)
    assert ann.search(empty, F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.search(empty, F.lit(True)).count() == 0


def test_scan_abandons_early():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[:30] = v[0] + rng.standard_normal((30, 64)) * 0.01
    index = ann.Index(v, float(np.linalg.norm(v, axis=1).max()), 1)
    q = v[:5]
    exact = np.sort(q @ v[5:].T, axis=1)[:, ::-1][:, :20]
    _, _, score, share = ann.scan_list(index, np.arange(5, 2000), v[5:], np.arange(5), q, exact[:, -1], 20)
    assert np.mean(np.sort(score.reshape(5, -1), axis=1)[:, ::-1][:, :20] >= exact[:, -1:] - 1e-9) > 0.95
    assert share < 0.6


# ---------------------------------------------------------------- urls

URLS = [
    ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    ("https://x.example.com/de/1#t", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("ftp://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://net", "net", "", None, None),
    ("http://a.net?q=/", "a.net", "", None, None),
    ("no scheme/a.net/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://É.NET/x", "É.net", "/x", "net/", "block"),
]
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("rate", T.DoubleType())])


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", 0.1) for i, u in enumerate(URLS)], PAGE)
    nothing = spark.createDataFrame([], "page_id bigint, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, nothing).collect()}
    assert got == {i: (h, p, r, v or "allow") for i, (_, h, p, r, v) in enumerate(URLS)}
    assert urls.judge(pages.limit(0), nothing).count() == 0


def test_reputation(spark):
    pages, outcomes = [], []

    def add(host, bad, good, unknown=0):
        for b in [1] * bad + [0] * good + [None] * unknown:
            pages.append((len(pages), f"http://{host}/p", "x", 0.0))
            outcomes.append((len(pages) - 1, b))

    add("spam.bad.io", 300, 20)
    add("new.bad.io", 0, 0, 3)       # no label of its own: as its domain
    add("other.bad.io", 280, 15)
    add("once.fine.com", 1, 0)       # one bad page says little
    add("big.fine.com", 10, 600)
    add("good.org", 2, 300)
    pages.append((None, "http://good.org/", None, None))
    frame = spark.createDataFrame(pages, PAGE)
    found = {r.host: r for r in urls.judge(frame, spark.createDataFrame(outcomes, "page_id bigint, bad int"), rules=()).collect()}
    assert found["spam.bad.io"].verdict == found["other.bad.io"].verdict == "block"
    assert found["once.fine.com"].verdict == found["big.fine.com"].verdict == found["good.org"].verdict == "allow"
    assert found["new.bad.io"].rate > 0.5 > found["once.fine.com"].rate > 1 / 60
    assert all(0 <= r.bound <= r.rate <= 1 for r in found.values())


def test_domains(spark):
    hosts = ["a.b.c.co.uk", "co.uk", "x.com", "com", "", "a.b.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string")
    domain = urls.domain_of(F.col("h"), ["co.uk"])
    got = [tuple(r) for r in rows.select(domain, urls.suffix_of(domain)).collect()]
    assert got == [("c.co.uk", "co.uk"), ("co.uk", "uk"), ("x.com", "com"), ("com", "com"), ("", ""), ("b.com", "com")]
