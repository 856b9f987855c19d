"""Hard negatives over zone-mapped blocks against a plain loop over all pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from claimspark.llm import negatives

VEC = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    # names that the operator uses itself
    T.StructField("rid", T.LongType()), T.StructField("block", T.LongType()), T.StructField("score", T.DoubleType()),
])

BIG = 1 << 62


def brute(rows, positives=5, negatives_=3, every=50):
    ok = []
    for i, (vid, vec, lab) in enumerate(rows):
        if lab is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        if vid is not None and vid % 7 == 0:
            lab = (lab + 1) % 10
        ok.append((i, vid, lab, [int(np.floor(256 * float(np.float32(x)))) for x in vec]))
    out = []
    for i, vid, lab, q in ok:
        if vid is None or vid % every:
            continue
        sc = [(sum(a * b for a, b in zip(q, r)), v, l) for j, v, l, r in ok if j != i]
        key = lambda t: (-t[0], BIG if t[1] is None else t[1])
        for ps, pid, _ in sorted([t for t in sc if t[2] == lab], key=key)[:positives]:
            neg = sorted([t for t in sc if t[2] != lab and 50 * ps <= 100 * t[0] <= 95 * ps], key=key)[:negatives_]
            out += [(vid, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(neg, 1)]
    return sorted(out, key=lambda t: tuple(BIG if x is None else x for x in t))


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (6, dims))
    labels = rng.integers(0, 4, n)
    which = rng.integers(0, 6, n)
    vecs = centres[which] + rng.normal(0, 0.08, (n, dims))
    return [(i, [float(x) for x in v.astype(np.float32)], int(l)) for i, (v, l) in enumerate(zip(vecs, labels))]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, 7, 0.5) for r in rows], VEC)
    got = negatives.mine_negatives(df, **kw).collect()
    return sorted([tuple(r) for r in got], key=lambda t: tuple(BIG if x is None else x for x in t))


@pytest.mark.parametrize(("n", "block_rows", "every"), [(400, 16, 10), (400, 256, 10), (150, 4, 5)])
def test_against_all_pairs(spark, n, block_rows, every):
    rows = clustered(n, 8, n + block_rows)
    assert run(spark, rows, block_rows=block_rows, anchor_every=every) == brute(rows, every=every)


def test_odd_rows(spark):
    rows = clustered(120, 6, 3)
    rows += [
        (None, [0.1] * 6, 1), (None, [0.1] * 6, 1),                      # NULL ids: candidates only
        (500, None, 1), (501, [0.2, None, 0.1, 0.1, 0.1, 0.1], 1),       # no vector, a NULL component
        (502, [float("nan")] * 6, 2), (503, [float("inf")] + [0.0] * 5, 2), (504, [0.3] * 6, None),
        (505, [0.05] * 6, 2), (505, [0.05] * 6, 2), (510, [0.05] * 6, 2),  # repeated rows and ties
        (520, [-0.2] * 6, 3),
    ]
    assert run(spark, rows, block_rows=8, anchor_every=5) == brute(rows, every=5)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.1, 0.2], 1), (2, [0.1, 0.3], 1)]) == []


def test_zone_bounds_hold():
    rng = np.random.default_rng(1)
    pts = rng.integers(0, 256, (500, 4))
    keys = negatives.hilbert_index(pts, 8)
    assert len(set(keys.tolist())) == len({tuple(p) for p in pts.tolist()})
    # neighbours on the curve are neighbours in space: consecutive cells differ in one step
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    order = grid[np.argsort(negatives.hilbert_index(grid, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_sql_agrees(tmp_path):
    rows = clustered(300, 8, 9)
    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                             "label": pa.array([r[2] for r in rows], pa.int32())}), tmp_path / "e.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path / 'e.parquet'}'")
    got = sorted(tuple(r) for r in con.execute(negatives.SQL).fetchall())
    assert got == brute(rows)
