"""Changes between two snapshots of a chunk table: inserted, deleted, updated, moved and kept chunks.

Chunks are matched by content hash: the k-th occurrence of a hash in a file's old snapshot meets the
k-th occurrence in the new one (a full outer join on file, hash and k). Among the matched chunks of a
file, those on one longest run that increases in both old and new position stay where they were
(``kept``); the others have ``moved``. So moving one paragraph marks that paragraph alone, and is neither
a deletion nor an insertion. Unmatched chunks at the same position of a file on both sides are an
``updated`` chunk; the other unmatched ones are ``deleted`` or ``inserted``.

The increasing run is found per file (patience sorting, n log n); a file's chunks are one document's
paragraphs, the unit any chunker already holds whole. The canonical run: its last chunk is the one with
the least new position among the ends of longest runs, and each chunk's predecessor is the one with the
least new position among the earlier ends of runs one shorter.

Defined cases: a NULL file name is a file of its own (the empty name is another); a NULL chunk is the empty
text; repeated equal chunks are matched in order; a file in one snapshot only is all inserted or deleted;
two empty snapshots give no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "fkey string, no_name boolean, old_pos int, new_pos int, change string, chunk_sha256 string"


def longest_run(new_positions: list[int]) -> set[int]:
    """Indexes (in old order) of the canonical longest strictly increasing run of ``new_positions``."""
    tails: list[int] = []         # least end value of a run of each length
    tail_at: list[int] = []       # index of that end
    before = [-1] * len(new_positions)
    for i, x in enumerate(new_positions):
        k = bisect_left(tails, x)
        before[i] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(x)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = x, i
    run, i = set(), tail_at[-1] if tail_at else -1
    while i >= 0:
        run.add(i)
        i = before[i]
    return run


def _kept_or_moved(group: pd.DataFrame) -> pd.DataFrame:
    ordered = group.sort_values("old_pos", kind="stable")
    run = longest_run(ordered["new_pos"].tolist())
    change = ["kept" if i in run else "moved" for i in range(len(ordered))]
    return ordered.assign(change=change)[["fkey", "no_name", "old_pos", "new_pos", "change", "chunk_sha256"]]


def chunk_changes(old: DataFrame, new: DataFrame, key: str = "file_name", pos: str = "pos", chunk: str = "chunk") -> DataFrame:
    """One row per chunk of either snapshot: ``file_name, old_pos, new_pos, change, chunk_sha256``."""

    def side(df: DataFrame, name: str) -> DataFrame:
        h = F.sha2(F.coalesce(F.col(chunk), F.lit("")), 256)
        keyed = df.select(
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias("fkey"), F.col(key).isNull().alias("no_name"), F.col(pos).cast("int").alias(name),
            h.alias("chunk_sha256"),
        )
        nth = Window.partitionBy("fkey", "no_name", "chunk_sha256").orderBy(name)
        return keyed.withColumn("k", F.row_number().over(nth))

    both = side(old, "old_pos").join(side(new, "new_pos"), ["fkey", "no_name", "chunk_sha256", "k"], "full_outer")
    matched = both.where(F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull())
    placed = matched.select("fkey", "no_name", "old_pos", "new_pos", "chunk_sha256").groupBy("fkey", "no_name").applyInPandas(
        lambda g: _kept_or_moved(g), OUT
    )
    lone = both.where(F.col("old_pos").isNull() | F.col("new_pos").isNull()).withColumn(
        "at", F.coalesce("old_pos", "new_pos")
    )
    # an unmatched chunk on each side at one position of a file is one updated chunk
    lone_old = lone.where(F.col("new_pos").isNull()).select("fkey", "no_name", "at", F.col("chunk_sha256").alias("old_hash"))
    lone_new = lone.where(F.col("old_pos").isNull()).select("fkey", "no_name", "at", F.col("chunk_sha256").alias("new_hash"))
    paired = lone_old.join(lone_new, ["fkey", "no_name", "at"], "full_outer").select(
        "fkey", "no_name",
        F.when(F.col("old_hash").isNotNull(), F.col("at")).cast("int").alias("old_pos"),
        F.when(F.col("new_hash").isNotNull(), F.col("at")).cast("int").alias("new_pos"),
        F.when(F.col("old_hash").isNotNull() & F.col("new_hash").isNotNull(), "updated")
        .when(F.col("old_hash").isNotNull(), "deleted").otherwise("inserted").alias("change"),
        F.coalesce("new_hash", "old_hash").alias("chunk_sha256"),
    )
    name = F.when(~F.col("no_name"), F.col("fkey")).alias("file_name")
    return placed.unionByName(paired).select(name, "old_pos", "new_pos", "change", "chunk_sha256")
