"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialise

ROWS_PER_SLICE = 2_000_000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def hot_keys(counts: DataFrame, key: str, rows: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The keys with more than ``rows_per_slice`` rows and the number of slices to cut each into.

    ``counts`` is one row per key, that is already pre-aggregated. Each key on the list owns more than
    ``rows_per_slice`` rows, so the list is that much shorter than the table. NULL is listed like any other key.
    """
    slices = F.ceil(F.col(rows) / F.lit(rows_per_slice)).cast("bigint")
    return counts.where(F.col(rows) > rows_per_slice).select(F.col(key).alias("_hot"), slices.alias("_slices"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Column,
    hot: DataFrame,
    how: str = "left",
) -> DataFrame:
    """Equi-join on ``key`` with the hot keys of ``left`` cut into slices.

    A hot left row goes to the slice its ``spread`` value hashes to, rows without a key too; only the right
    rows of hot keys are repeated, once per slice. ``how`` is ``left``, ``inner``, ``left_semi`` or
    ``left_anti``. Without a hot key it is a plain join, and the list is not made a second time.
    """
    n, size = _measure(hot, BROADCAST_ROWS)
    if n == 0:
        return left.join(right, key, how)
    flags = F.broadcast(hot) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else hot
    slice_of = F.when(
        F.col("_slices").isNotNull(),
        F.pmod(F.xxhash64(spread), F.col("_slices").cast("bigint")),
    ).otherwise(F.lit(0).cast("bigint"))
    sliced = (
        left.join(flags, left[key].eqNullSafe(flags["_hot"]), "left")
        .withColumn("_slice", slice_of)
        .drop("_hot", "_slices")
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_slices"), F.lit(1)) - F.lit(1).cast("bigint"))
    repeated = (
        right.join(flags, right[key] == flags["_hot"], "left")
        .withColumn("_slice", F.explode(copies))
        .drop("_hot", "_slices")
    )
    return sliced.join(repeated, [key, "_slice"], how).drop("_slice")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to broadcast, measured and not estimated."""
    n, total = _measure(df, rows)
    return n <= rows and total <= size


def _measure(df: DataFrame, rows: int) -> tuple[int, int]:
    """Rows and bytes, of at most ``rows + 1`` rows. Text is weighed by its length; numbers count 16 bytes."""
    head = df.limit(rows + 1)
    weight = sum(
        (
            F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
            if kind == "string"
            else F.lit(16) if not kind.startswith(("array", "map", "struct"))
            else F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
            for name, kind in df.dtypes
        ),
        F.lit(0).cast("bigint"),
    )
    n, total = head.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    return n, total


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Column,
    how: str = "left",
    rows: int = BROADCAST_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join to a table that is usually small: broadcast when it measures small, else salted.

    ``right`` should be cheap to read twice (a stored table or a small aggregate).
    """
    if is_small(right, rows):
        return left.join(F.broadcast(right), key, how)
    left = materialise(left, "lookup")     # counted and joined: computed once
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return salted_join(left, right, key, spread, hot_keys(counts, key, "_rows", rows_per_slice), how)
