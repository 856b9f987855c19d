"""Minimax contiguous partition of ordered atomic groups.

Groups keep their order and stay whole. The smallest capacity is sought for which filling shards
greedily, each up to the capacity, needs no more shards than asked. Under that capacity the cuts
are made as near to equal parts as it allows, else the last shard would be left short.
Everything that grows with the data is DataFrame work. The driver sees only a summary of group
boundaries, some ``CELLS`` rows a round: the summary is coarse at first, and only the
stretches in which a cut can still fall are looked at more closely.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import CRC_TABLE, crc32_sql, table
from claimspark.session import materialise

CELLS = 1 << 14

Cell = tuple[int, int, bool]     # from, to, whether it is one group


def running_total(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Add ``lo`` and ``hi``: the exclusive and inclusive running total of ``amount`` in ``order``.

    Range partitions get their totals first, so no task sorts more than its range. The rows are
    written once, which fixes the ranges.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stored = materialise(ranged, name)
    parts = stored.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        stored.withColumn("hi", F.sum(amount).over(inside))
        .join(F.broadcast(offsets), "_part")     # a row for each range partition
        .withColumn("hi", F.col("hi") + F.col("_base"))
        .withColumn("lo", F.col("hi") - F.col(amount))
        .drop("_part", "_base")
    )


class Boundaries:
    """What is known of the group boundaries: cells, each one group or a stretch of several.

    Look-ups in a stretch answer with a bound (``floor`` upward, ``ceil`` downward) and note it in ``open``.
    """

    def __init__(self, total: int) -> None:
        self.total, self.open = total, set()
        self.put([(0, total, False)])

    def put(self, cells: list[Cell]) -> None:
        self.cells = sorted(cells)
        self.starts = [c[0] for c in self.cells]

    def floor(self, target: int) -> int:
        """The last boundary up to ``target``."""
        if target >= self.total:
            return self.total
        i = bisect_right(self.starts, target) - 1
        start, _, single = self.cells[i]
        if start == target or single:
            return start
        self.open.add(i)
        return target

    def ceil(self, target: int) -> int:
        """The first boundary from ``target`` on."""
        if target <= 0:
            return 0
        i = bisect_right(self.starts, target) - 1
        start, end, single = self.cells[i]
        if start == target or single:
            return target if start == target else end
        self.open.add(i)
        return target

    def fits(self, shards: int, capacity: int) -> bool:
        """Whether greedy filling up to ``capacity`` needs no more than ``shards``."""
        at = 0
        for _ in range(shards):
            at = self.floor(at + capacity)
        return at >= self.total

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Ends of the shards: as near to equal parts as the capacity allows."""
        least = [self.total]
        for _ in range(shards - 1):
            least.append(self.ceil(least[-1] - capacity))
        ends, at = [], 0
        for i, earliest in enumerate(reversed(least), 1):
            even = self.floor(self.total * i // shards)
            at = max(at, min(max(even, earliest), self.floor(at + capacity)))
            ends.append(at)
        return ends

    def refine(self, bounds: DataFrame) -> None:
        """Replace the stretches that look-ups have met, and their neighbours, by finer cells."""
        near = {j for i in self.open for j in (i - 1, i, i + 1) if 0 <= j < len(self.cells)}
        near = {j for j in near if not self.cells[j][2]}
        spans: list[tuple[int, int]] = []
        for j in sorted(near):
            a, b, _ = self.cells[j]
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        self.put([c for j, c in enumerate(self.cells) if j not in near] + _detail(bounds, spans, max(CELLS, 8 * len(near))))
        self.open.clear()


def _detail(bounds: DataFrame, spans: list[tuple[int, int]], most: int) -> list[Cell]:
    """The groups of the spans, summed up in about ``most`` cells."""
    width = max(1, -(-sum(b - a for a, b in spans) // most))
    base = F.lit(None).cast("bigint")
    for a, b in spans:
        base = F.when((F.col("lo") >= a) & (F.col("lo") < b), F.lit(a)).otherwise(base)
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | ((F.col("lo") >= a) & (F.col("lo") < b))
    rows = (
        bounds.where(inside)
        .withColumn("_base", base)
        .groupBy("_base", F.floor((F.col("lo") - F.col("_base")) / width).alias("_cell"))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
        .collect()     # as many rows, and one more for each span, at most
    )
    return [(r["lo"], r["hi"], r["n"] == 1) for r in rows]


def minimax_cuts(bounds: DataFrame, shards: int) -> list[int]:
    """Ends of the shards on the running total, for groups given as ``lo, hi`` without gaps.

    The capacity is the smallest one possible: below it even the bounds of the summary do not
    fit, and at it the filling is known group by group. An empty table has no cuts.
    """
    total, largest = bounds.agg(F.max("hi"), F.max(F.col("hi") - F.col("lo"))).first()
    if total is None:
        return []
    known, share = Boundaries(total), -(-total // shards)
    low = max(share, largest)
    while True:
        high = share + largest     # always enough: a shard that is closed holds more than its share
        while low < high:
            middle = (low + high) // 2
            if known.fits(shards, middle):
                high = middle
            else:
                low = middle + 1
        known.open.clear()
        if known.fits(shards, low):
            ends = known.cuts(shards, low)
        if not known.open:
            return ends
        known.refine(bounds)


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; equal texts share a shard.

    Size is the UTF-8 length plus 8. Groups of equal texts are ordered by their smallest id (NULL
    last), then by content. Slots count a shard's rows from 0 in the order of groups and ids. A NULL text has size
    8 and no checksum; NULL texts are one group. Repeated rows each get a slot. An empty table
    gives no rows; fewer groups than shards leave shards empty. Other columns are not carried.
    """
    rows = materialise(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), F.lit(b"")).alias("content"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("content").agg(
        F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("first_id"), F.sum("size").alias("bytes")
    )
    bounds = materialise(
        running_total(groups, ["first_id", "content"], "bytes", "shard-groups").select("content", "lo", "hi"),
        "shard-bounds",
    )
    cuts = minimax_cuts(bounds.select("lo", "hi"), shards)
    shard = sum(((F.col("lo") >= c).cast("int") for c in cuts[:-1]), F.lit(0))
    placed = rows.join(bounds.select("content", "lo"), "content").select(
        "doc_id", "size", "text_crc32", "lo", shard.alias("shard")
    )
    return _slots(placed)


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard; copies of one text may fill many ranges."""
    order = ["lo", "doc_id", "text_crc32"]
    stored = materialise(
        placed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "shard-placed"
    )
    counts = stored.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", "shard").orderBy(*order)
    return (
        stored.withColumn("slot", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "_part"])     # a row for each range and shard in it
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("_base")).cast("bigint").alias("slot"))
    )


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, text FROM documents
), g AS (
  SELECT text, coalesce(min(doc_id), 9223372036854775807) AS first_id, sum(size)::BIGINT AS bytes FROM r GROUP BY text
), p AS (
  SELECT text, bytes, (sum(bytes) OVER (ORDER BY first_id, text NULLS FIRST))::BIGINT AS hi FROM g
), b AS (
  SELECT hi AS x FROM p UNION SELECT 0::BIGINT
), t AS (
  SELECT max(x) AS total FROM b
), f AS (
  SELECT 1 AS k, x, x AS v FROM b
  UNION ALL
  SELECT f.k + 1, b.x, min(greatest(f.v, b.x - f.x)) FROM f JOIN b ON f.x <= b.x WHERE f.k < 24 GROUP BY f.k, b.x
), c AS (
  SELECT v AS cap FROM f, t WHERE k = 24 AND x = total
), l AS (
  SELECT 24 AS i, total AS x FROM t
  UNION ALL
  SELECT l.i - 1, min(b.x) FROM l, c, b WHERE l.i > 1 AND b.x >= l.x - cap GROUP BY l.i
), e AS (
  SELECT i, max(x) AS x FROM range(1, 25) s(i), t, b WHERE x <= total * i // 24 GROUP BY i
), cuts AS (
  SELECT 0 AS i, 0::BIGINT AS pos
  UNION ALL
  SELECT cuts.i + 1, greatest(any_value(cuts.pos), least(greatest(any_value(e.x), any_value(l.x)), max(b.x)))
  FROM cuts, c, b, e, l
  WHERE cuts.i < 24 AND b.x <= cuts.pos + cap AND e.i = cuts.i + 1 AND l.i = cuts.i + 1 GROUP BY cuts.i
), placed AS (
  SELECT r.*, p.hi - p.bytes AS lo,
         (SELECT count(*) FROM cuts WHERE i BETWEEN 1 AND 23 AND pos <= p.hi - p.bytes)::INT AS shard
  FROM r JOIN p ON r.text IS NOT DISTINCT FROM p.text
)
SELECT doc_id, size::BIGINT AS size, {crc32_sql('text')} AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY lo, doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed, crc_table
"""
