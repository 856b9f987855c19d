"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more coordinate, so that the largest inner product is the smallest distance, and are
dealt to lists by centroids. A query visits the lists nearest to it. Inside a list vectors are compared
in a randomly rotated space, some columns at a time: the distance over the first columns, scaled up,
estimates the whole, and a hypothesis test abandons a candidate as soon as it is too far to be among
the nearest, at a chosen chance of error. What is left is scored exactly on the original vectors.
The nearest lists are scanned first, so that the others start from what was found there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import drawn, table
from claimspark.session import materialise

SAMPLE = 20_000        # vectors that the centroids are fitted on
PROBED = 0.8           # share of the lists that a query visits
FIRST = 0.1            # share that it visits first
EPSILON = 1.5          # of the test: the chance to abandon a true neighbour falls with its square
HEAD, COLUMNS = 32, 16     # compared at first, and at a time from there on
LIST_ROWS, QUERY_ROWS = 4096, 1024     # of a list and of its queries in one task
MOST_LISTS = 4096


def usable(vector: Column) -> Column:
    """Neither NULL nor zero, and every component there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Index:
    """Centroids and the rotation. ``sizes`` is how many vectors each list has."""

    def __init__(self, sample: np.ndarray, most: float, lists: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.most = most
        x = self.lifted(sample)
        self.dim = x.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        lists = min(lists, len(x))
        self.centroids = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(10):
            near = self.nearest(x)
            for j in range(lists):
                if (near == j).any():
                    self.centroids[j] = x[near == j].mean(axis=0)
        self.sizes = np.zeros(lists, dtype=np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """With the coordinate that gives all vectors the same length."""
        return np.hstack([x, np.sqrt(np.maximum(self.most**2 - (x * x).sum(axis=1), 0))[:, None]])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T).argmin(axis=1)

    def probes(self, queries: np.ndarray, share: float, k: int) -> list[np.ndarray]:
        """The lists that each query visits: a share of them, and more until they hold enough vectors."""
        order = np.argsort(-(queries @ self.centroids[:, :-1].T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        n = np.maximum(int(np.ceil(share * len(self.sizes))), (held < k + 1).sum(axis=1) + 1)
        return [o[:m] for o, m in zip(order, n)]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scan_list(
    index: Index, ids: np.ndarray, v: np.ndarray, asking: np.ndarray, q: np.ndarray, known: np.ndarray, k: int, epsilon: float = EPSILON
):
    """``query, vector, score`` arrays: for each query its nearest ``k`` of a list, and what was compared.

    ``known``: a score that ``k`` vectors elsewhere reach, or minus infinity. The last value is the number of
    column blocks computed, as a share of all.
    """
    own, dim = np.argsort(ids, kind="stable"), index.dim
    ids, v = ids[own], v[own]
    vr = (index.lifted(v) @ index.rotation).astype(np.float32)
    qr = (np.hstack([q, np.zeros((len(q), 1))]) @ index.rotation).astype(np.float32)
    cuts = [*range(HEAD, dim, COLUMNS), dim]
    allowed = [(1 + epsilon / d**0.5) ** 2 * d / dim for d in cuts[:-1]] + [1 + 1e-4]
    head_v, head_q = vr[:, : cuts[0]], qr[:, : cuts[0]]
    first = (head_v**2).sum(axis=1) + (head_q**2).sum(axis=1)[:, None] - 2 * head_q @ head_v.T
    found, done, total = [], 0, 0
    length = (q * q).sum(axis=1) + index.most**2
    for i in range(len(q)):
        best_ids, best, reach = np.zeros(0, dtype=np.int64), np.zeros(0), np.inf
        if known[i] > -np.inf:
            reach = max(length[i] - 2 * known[i], 0.0) + 1e-6
        for start, end in ((0, min(256, len(v))), (256, len(v))):
            alive = np.arange(start, end)
            alive = alive[ids[alive] != asking[i]]
            part, total, done = first[i, alive], total + len(alive) * len(cuts), done + len(alive)
            for c, factor in enumerate(allowed):
                if c:
                    stretch = slice(cuts[c - 1], cuts[c])
                    gap = vr[alive, stretch] - qr[i, stretch]
                    part, done = part + np.einsum("ij,ij->i", gap, gap), done + len(alive)
                near = part <= factor * reach
                alive, part = alive[near], part[near]
            scores = (v[alive] * q[i]).sum(axis=1)
            best_ids, best = np.concatenate([best_ids, ids[alive]]), np.concatenate([best, scores])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            if len(top) == k:
                reach = min(reach, max(length[i] - 2 * best[-1], 0.0) + 1e-6)
        found.append((np.full(len(best), asking[i]), best_ids, best))
    query, vector, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return query, vector, score, done / max(total, 1)


def search(vectors: DataFrame, asked: Column, k: int = 20, probed: float = PROBED, lists: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product found for each query.

    ``vectors``: ``vec_id, embedding``; queries are the rows for which ``asked`` holds, candidates all rows of
    another id. Ranks count from 1, ties go to the smaller id. NULL and zero vectors, those with NULL or non-finite
    components, those of another length than most, and NULL ids take no part; repeated rows of an id are
    candidates each, and one query. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, vec_id bigint, score double"
    v = F.col("embedding")
    good = materialise(
        vectors.where(F.col("vec_id").isNotNull() & usable(v))
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"), asked.alias("asked")),
        "ann-vectors",
    )
    lengths = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = lambda rows: rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if lengths is None:
        return ranked(spark.createDataFrame([], schema))
    good = good.where(F.size("v") == lengths["dim"])
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    most = good.agg(F.sqrt(F.max(norm))).first()[0]
    n = lengths["count"]
    some = good.where(drawn(F.col("vec_id"), SAMPLE, n))
    sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    index = Index(np.array([r["v"] for r in sample]), most, lists or int(min(MOST_LISTS, max(n**0.5 / 4, min(16, n // 16), 1))))

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                near = index.nearest(index.lifted(matrix(batch.column("v"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "list"])

    dealt = materialise(good.mapInArrow(deal, "vec_id bigint, v array<double>, asked boolean, list bigint"), "ann-lists")
    for r in dealt.groupBy("list").count().collect():     # a row for each list
        index.sizes[r["list"]] = r["count"]

    def visit(batches):
        for batch in batches:
            if batch.num_rows:
                lots = index.probes(matrix(batch.column("v")), probed, k)
                early = [np.arange(len(x)) < max(1, int(np.ceil(FIRST * len(index.sizes)))) for x in lots]
                rows = pa.array(np.repeat(np.arange(len(lots)), [len(x) for x in lots]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(rows), batch.column("v").take(rows), pa.array(np.concatenate(lots)), pa.array(np.concatenate(early))],
                    ["vec_id", "v", "list", "early"],
                )

    queries = dealt.where("asked").dropDuplicates(["vec_id"]).select("vec_id", "v")
    visits = materialise(queries.mapInArrow(visit, "vec_id bigint, v array<double>, list bigint, early boolean"), "ann-visits")

    def scan(some: pa.Table, asking: pa.Table) -> pa.Table:
        if not (some.num_rows and asking.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x, s, _ = scan_list(
            index, some["vec_id"].to_numpy(), matrix(some["v"]),
            asking["vec_id"].to_numpy(), matrix(asking["v"]), asking["known"].to_numpy(), k,
        )
        return pa.table({"query_id": q, "vec_id": x, "score": s})

    def scanned(asking: DataFrame) -> DataFrame:
        counts = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("v_lots")).join(
            asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("q_lots")), "list"
        )
        counts = F.broadcast(counts)     # a row for each list, MOST_LISTS at most
        lot = lambda lots: F.pmod(F.xxhash64("vec_id"), F.col(lots))
        every = lambda lots: F.explode(F.sequence(F.lit(0), F.col(lots) - 1))
        key = ["list", "v_lot", "q_lot"]
        left = dealt.join(counts, "list").withColumn("v_lot", lot("v_lots")).withColumn("q_lot", every("q_lots"))
        right = asking.join(counts, "list").withColumn("q_lot", lot("q_lots")).withColumn("v_lot", every("v_lots"))
        return (
            left.select(*key, "vec_id", "v").groupBy(*key)
            .cogroup(right.select(*key, "vec_id", "v", "known").groupBy(*key)).applyInArrow(scan, schema)
        )

    nearest = materialise(ranked(scanned(visits.where("early").withColumn("known", F.lit(float("-inf"))))), "ann-first")
    reached = nearest.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("known"))
    others = (
        visits.where("not early").join(reached.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        .withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
    )
    return ranked(nearest.select("query_id", "vec_id", "score").unionByName(scanned(others)))


def op5_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.coalesce(F.pmod(F.col("vec_id"), F.lit(20)) == 0, F.lit(False))).select(
        "query_id", "rank", "vec_id", "score"
    )
