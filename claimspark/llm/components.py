"""Connected components of a table of links.

Up to a fixed number of links are joined up in one task. More are joined by alternating large and small
stars: each round hangs neighbours on the smallest node known about, and the number of rounds grows with
the logarithm of the longest chain. Links stay distributed, and each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialise


TASK_LINKS = 1_000_000     # joined up in one task, some 100 MB


def connected_components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links`` (columns ``a, b``).

    Links of a node to itself and NULL ends are passed over; repeated links count once. The answer is
    the same on both sides of ``task_links``.
    """
    ordered = links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    now = materialise(ordered.distinct(), "links")
    if now.count() <= task_links:
        return materialise(now.coalesce(1).mapInArrow(_join_up, "node bigint, component bigint"), "components")
    before = None
    while True:
        # a fingerprint of the links: they have settled when a round leaves it alone
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("low", "high")), F.lit(0))).first()
        if mark == before:
            return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
                now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        before = mark
        now = materialise(_small_star(_large_star(now)), "links")


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest node of each component, by passing minima along all links until they settle."""
    pairs = [np.stack([b.column("low").to_numpy(), b.column("high").to_numpy()]) for b in batches]
    if not pairs:
        return
    nodes, ends = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    low, high = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[low], label[high])
        after = label.copy()
        # hang the labels themselves, so that whole stretches move at once
        np.minimum.at(after, label[low], least)
        np.minimum.at(after, label[high], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    ways = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
        links.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    least = ways.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is hung on the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("m"))
    moved = links.join(least, "high").where("low <> m").select(F.col("m").alias("low"), F.col("low").alias("high"))
    return moved.unionByName(least.select(F.col("m").alias("low"), "high")).distinct()
