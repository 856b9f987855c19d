"""Hard-negative mining over Hilbert-ordered blocks with per-dimension zone maps.

Candidates are sorted by label and by the Hilbert index of their leading components, cut into blocks of
``BLOCK_ROWS`` rows and written as Parquet; every block gets a zone map, the least and greatest value of
each component. For an anchor, interval arithmetic over a zone map bounds the integer inner product of
every row in the block from below and above. These bounds choose, for each anchor, the blocks that can
hold one of its first positives, and for each of its windows of negative scores, the blocks that can hold
one of its first negatives; only those blocks are read and scored exactly.

Anchors are the stated query set (every ``ANCHOR_EVERY``-th id); they meet the zone maps in blocks of
zones, never row by row, and the rows of a block only where a bound asks for it.

Defined cases: rows with a NULL label, a NULL vector, or a NULL, NaN or infinite component take no part.
A NULL vec_id takes part as a candidate (it is never an anchor, nor relabelled) and comes after every id
on equal scores. Repeated rows are separate candidates; an anchor never meets its own row. An empty table
or one without anchors gives no rows. A positive with a score below zero has an empty window (no
negatives); an anchor with fewer than ``POSITIVES`` same-label rows uses all it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import table
from claimspark.session import materialise

BLOCK_ROWS = 256        # rows of a candidate block
ZONES_PER_PART = 512    # zone maps that one task bounds against a chunk of anchors
HILBERT_DIMS = 4        # leading components that order the blocks
HILBERT_BITS = 8
ANCHOR_EVERY = 50
RELABEL_EVERY = 7
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95      # the window: LOW * positive <= 100 * negative <= HIGH * positive


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along a Hilbert curve of points with ``bits``-bit unsigned coordinates (Skilling's transform)."""
    x = points.astype(np.uint64).copy()
    n, dims = x.shape
    if n == 0 or dims == 0:
        return np.zeros(n, dtype=np.int64)
    top = np.uint64(1) << np.uint64(bits - 1)
    q = top
    while q > 1:                                   # inverse undo of the excess work
        p = q - np.uint64(1)
        for i in range(dims):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= p
            t = (x[~high, 0] ^ x[~high, i]) & p
            x[~high, 0] ^= t
            x[~high, i] ^= t
        q >>= np.uint64(1)
    for i in range(1, dims):                       # Gray encode
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, dtype=np.uint64)
    q = top
    while q > 1:
        t[(x[:, dims - 1] & q) != 0] ^= q - np.uint64(1)
        q >>= np.uint64(1)
    x ^= t[:, None]
    key = np.zeros(n, dtype=np.uint64)             # interleave, most significant bit first
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


@F.pandas_udf(T.LongType())
def _hilbert(q: pd.Series) -> pd.Series:
    lead = np.zeros((len(q), HILBERT_DIMS), dtype=np.int64)
    for r, v in enumerate(q):
        k = min(HILBERT_DIMS, len(v))
        lead[r, :k] = v[:k]
    half = 1 << (HILBERT_BITS - 1)
    grid = np.clip(lead + half, 0, (1 << HILBERT_BITS) - 1)
    return pd.Series(hilbert_index(grid, HILBERT_BITS))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, v: s + v)


def _bound(a: Column, low: Column, high: Column, pick) -> Column:
    """Least or greatest inner product of ``a`` with any vector inside the box ``[low, high]``."""
    box = F.arrays_zip(a.alias("a"), low.alias("l"), high.alias("h"))
    return F.aggregate(box, F.lit(0).cast("bigint"), lambda s, z: s + pick(z["a"] * z["l"], z["a"] * z["h"]))


def candidates(vectors: DataFrame) -> DataFrame:
    """Rows that take part, relabelled, with integer components ``q`` and a row key ``rid``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % 10)
            .otherwise(F.col("label")).cast("int").alias("label"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint")).alias("q"),
        )
    )


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows sorted by label and Hilbert index, cut into blocks, written once: ``rid, vec_id, label, q, block``."""
    order = [F.col("label"), F.col("hkey"), F.col("vec_id"), F.col("tie")]
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    sorted_rows = (
        rows.withColumn("hkey", _hilbert("q"))
        .withColumn("tie", F.xxhash64(F.col("q")))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("rid", F.monotonically_increasing_id())
    )
    # a block lies in one task's range and holds one label; its number tells the task and the place
    within = F.col("rid").bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftleft(F.shiftright("rid", 33), 24) + F.floor(within / block_rows).cast("bigint")
    return materialise(sorted_rows.withColumn("block", block).drop("hkey", "tie"), "negatives-blocks")


def zone_maps(blocked: DataFrame) -> DataFrame:
    """Per block and label: row count, and the least and greatest value of each component."""
    per = (
        blocked.select("block", "label", "rid", F.posexplode("q").alias("d", "x"))
        .groupBy("block", "label", "d")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    )
    return per.groupBy("block", "label").agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("box"),
    ).select("block", "label", "n", F.col("box.lo").alias("lo"), F.col("box.hi").alias("hi"))


def _anchor_zones(anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """Every anchor against every zone map, in chunks of ``ZONES_PER_PART`` zones: bounds ``lb, ub``."""
    parts = F.pmod(F.xxhash64("block", "label"), F.lit(1 << 30))
    zoned = zones.withColumn("part", parts)
    count = zoned.agg(F.count("*")).first()[0]
    chunks = max(1, -(-count // ZONES_PER_PART))
    zoned = zoned.withColumn("part", F.col("part") % chunks)
    a = anchors.select(
        F.col("rid").alias("a_rid"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"),
        F.col("q").alias("a_q"), F.col("block").alias("a_block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("part"),
    )
    return a.join(zoned, "part").select(
        "a_rid", "anchor_id", "a_label", "a_block", "block", "label", "n",
        _bound(F.col("a_q"), F.col("lo"), F.col("hi"), F.least).alias("lb"),
        _bound(F.col("a_q"), F.col("lo"), F.col("hi"), F.greatest).alias("ub"),
    )


def _first(threshold_rows: int, by: list[str]) -> Column:
    """Lower bound of the zone at which the guaranteed rows, best first, reach ``threshold_rows``."""
    w = Window.partitionBy(*by).orderBy(F.col("lb").desc(), F.col("block"), F.col("label"))
    cum = F.sum("guaranteed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(cum >= threshold_rows, F.col("lb"))


ANCHORS_PER_GROUP = 2048   # anchors that meet one block in one group
_BIG = (1 << 63) - 1


def _stack(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length stacked: length -> (row indexes, int64 matrix)."""
    by_len: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_len.setdefault(len(v), []).append(i)
    return {n: (np.asarray(ix), np.stack([np.asarray(vectors[i], dtype=np.int64) for i in ix]) if n else np.zeros((len(ix), 0), np.int64))
            for n, ix in by_len.items()}


def _top_in_blocks(keep: int, windows: bool):
    """Exact scores of one block's rows against the anchors that need it, as integer matrix products.

    Only each anchor's first ``keep`` rows leave the group (per window of negative scores if ``windows``);
    the anchor's own row is no candidate, and vectors of another length than the anchor's have no score.
    """
    def run(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(r):
            rows_by_len = _stack(list(r["q"]))
            vid_key = r["vkey"].to_numpy(dtype=np.int64)
            vnull = r["vnull"].to_numpy(dtype=bool)
            rid = r["rid"].to_numpy(dtype=np.int64)
            anchors_by_len = _stack(list(a["a_q"]))
            for n, (aix, amat) in anchors_by_len.items():
                if n not in rows_by_len:
                    continue
                rix, rmat = rows_by_len[n]
                scores = amat @ rmat.T
                for k, i in enumerate(aix):
                    s = scores[k]
                    ok = rid[rix] != a["a_rid"].iat[i]
                    tests = [(None, None, ok)]
                    if windows:
                        tests = [
                            (p_rid, ps, ok & (LOW * ps <= 100 * s) & (100 * s <= HIGH * ps))
                            for p_rid, ps in zip(a["p_rids"].iat[i], a["p_scores"].iat[i])
                        ]
                    for p_rid, ps, mask in tests:
                        idx = np.flatnonzero(mask)
                        if not len(idx):
                            continue
                        order = np.lexsort((rid[rix][idx], vid_key[rix][idx], -s[idx]))[:keep]
                        for j in idx[order]:
                            row = rix[j]
                            out.append((int(a["a_rid"].iat[i]), p_rid, ps, int(rid[row]),
                                        None if vnull[row] else int(vid_key[row]), int(s[j])))
        return pd.DataFrame(out, columns=["a_rid", "p_rid", "positive_score", "rid", "vec_id", "score"])

    return run


_TOP = "a_rid long, p_rid long, positive_score long, rid long, vec_id long, score long"


def _scored(anchors: DataFrame, needed: DataFrame, blocked: DataFrame, keep: int, windows: DataFrame | None = None) -> DataFrame:
    """The first ``keep`` rows of each needed block for each anchor (and window): ``a_rid, [p_rid, positive_score,] rid, vec_id, score``."""
    n_anchors = needed.select("a_rid").distinct().count()
    groups = max(1, -(-n_anchors // ANCHORS_PER_GROUP))
    a = anchors.select(F.col("rid").alias("a_rid"), F.col("q").alias("a_q"))
    if windows is not None:
        a = a.join(
            windows.groupBy("a_rid").agg(F.collect_list("p_rid").alias("p_rids"), F.collect_list("positive_score").alias("p_scores")),
            "a_rid",
        )
    else:
        a = a.select("*", F.array().cast("array<long>").alias("p_rids"), F.array().cast("array<long>").alias("p_scores"))
    need = materialise(
        needed.select("a_rid", "block", "label").withColumn("g", F.pmod(F.xxhash64("a_rid"), F.lit(groups))), "negatives-needed"
    )
    left = need.join(a, "a_rid")
    right = blocked.select(
        "block", "label", "rid", F.coalesce("vec_id", F.lit(_BIG)).alias("vkey"), F.col("vec_id").isNull().alias("vnull"), "q"
    ).join(need.select("block", "label", "g").distinct(), ["block", "label"])
    keys = ["block", "label", "g"]
    # both sides come from one written table: new names keep the grouping keys apart
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_top_in_blocks(keep, windows is not None), _TOP)


def mine_negatives(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_every: int = ANCHOR_EVERY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Hard negatives for each anchor and each of its first positives (see the module's docstring)."""
    blocked = blocks(candidates(vectors), block_rows)
    zones = materialise(zone_maps(blocked), "negatives-zones")
    anchors = blocked.where(F.col("vec_id") % anchor_every == 0)
    pairs = materialise(_anchor_zones(anchors, zones), "negatives-bounds")

    # positives: same-label zones; the anchor's own row is no candidate
    same = pairs.where(F.col("label") == F.col("a_label")).withColumn(
        "guaranteed", F.col("n") - F.when(F.col("block") == F.col("a_block"), 1).otherwise(0)
    )
    cut = same.withColumn("t", _first(positives, ["a_rid"])).withColumn(
        "t", F.max("t").over(Window.partitionBy("a_rid"))
    )
    wanted = cut.where(F.col("t").isNull() | (F.col("ub") >= F.col("t"))).select("a_rid", "anchor_id", "a_label", "block", "label")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("rid")]
    best = (
        _scored(anchors, wanted, blocked, positives)
        .join(wanted.select("a_rid", "anchor_id", "a_label").distinct(), "a_rid")
        .withColumn("r", F.row_number().over(Window.partitionBy("a_rid").orderBy(*order)))
        .where(F.col("r") <= positives)
        .select("a_rid", "anchor_id", "a_label", F.col("vec_id").alias("positive_id"), F.col("rid").alias("p_rid"),
                F.col("score").alias("positive_score"))
    )
    best = materialise(best, "negatives-positives")

    # negatives: other-label zones that meet a window; zones wholly inside a window guarantee rows
    other = pairs.where(F.col("label") != F.col("a_label")).drop("a_label", "anchor_id")
    windows = best.select("a_rid", "p_rid", "positive_score")
    meet = other.join(windows, "a_rid").where(
        (100 * F.col("ub") >= LOW * F.col("positive_score")) & (100 * F.col("lb") <= HIGH * F.col("positive_score"))
        & (F.col("positive_score") >= 0)
    )
    inside = (100 * F.col("lb") >= LOW * F.col("positive_score")) & (100 * F.col("ub") <= HIGH * F.col("positive_score"))
    meet = meet.withColumn("guaranteed", F.when(inside, F.col("n")).otherwise(0))
    meet = meet.withColumn("t", _first(negatives, ["a_rid", "p_rid"])).withColumn(
        "t", F.max("t").over(Window.partitionBy("a_rid", "p_rid"))
    )
    wanted = meet.where(F.col("t").isNull() | (F.col("ub") >= F.col("t"))).select("a_rid", "block", "label").distinct()
    found = _scored(anchors, wanted, blocked, negatives, windows).join(
        best.select("a_rid", "anchor_id").distinct(), "a_rid"
    )
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("a_rid", "p_rid").orderBy(*order))
    ).where(F.col("rank") <= negatives)
    return ranked.join(best.select("a_rid", "p_rid", "positive_id"), ["a_rid", "p_rid"]).select(
        F.col("anchor_id").cast("bigint"), F.col("positive_id").cast("bigint"), F.col("rank").cast("int"),
        F.col("vec_id").cast("bigint").alias("negative_id"), F.col("positive_score").cast("bigint"),
        F.col("score").cast("bigint").alias("negative_score"),
    )


def op11_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS a_label, r.vec_id, r.label,
         coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])), 0) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % {ANCHOR_EVERY} = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
        FROM s WHERE label = a_label) x
  WHERE r <= {POSITIVES}
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.a_label
  WHERE {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
)
SELECT CAST(anchor_id AS BIGINT) AS anchor_id, CAST(positive_id AS BIGINT) AS positive_id, CAST(rank AS INTEGER) AS rank,
       CAST(negative_id AS BIGINT) AS negative_id, CAST(positive_score AS BIGINT) AS positive_score,
       CAST(negative_score AS BIGINT) AS negative_score
FROM n WHERE rank <= {NEGATIVES}
"""
