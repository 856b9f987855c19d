"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points fall into the stretches that the sources' targets take of the unit interval,
so any run of the schedule holds each source in nearly its share. The r-th slot of a source takes
the r-th block of equally many words from the source's shuffled stream; a stream may be passed
through more than once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import N_WORDS_PATTERN, fresh, n_words, packed, table
from claimspark.session import materialise

BLOCK_WORDS = 64
POINTS = 1 << 31               # resolution of the unit interval
GOLDEN = 1327217885            # the odd number next to POINTS / golden ratio
CHUNK = 1 << 16                # slots ranked in one task
ROWS_PER_BUCKET = 2_000        # stream rows summed up together
CELL_BITS = 19                 # the interval is cut in POINTS >> CELL_BITS cells to find a point's source


def _named(source: Column) -> Column:
    """The source as a join key; NULL is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``_source, n_rows, source_size, target, lo, hi``: a row per source.

    Weights repeat over the sources in code point order, NULL last. A target stops at ``most``
    times its source; what is cut off goes to the others by weight. ``lo`` to ``hi`` is the
    source's stretch of the points.
    """
    totals = sized.groupBy("_source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"), F.first("source").alias("source")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1     # a row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("_weight"), "_place")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_turn = Window.orderBy("_place")
    size, free = F.col("source_size"), F.col("_free")
    return (
        totals.withColumn("_place", place)
        .withColumn("_weight", weight)
        .withColumn("_before", F.coalesce(F.sum(size).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_total", F.sum(size).over(everything))
        # with all sources before it capped, what one unit of weight would get
        .withColumn("_level", (F.col("_total") * share - F.col("_before") * most) / F.col("_weights"))
        .withColumn("_free", size * most > F.col("_level") * F.col("_weight"))
        # the first source below its cap is the one with the largest remaining weight
        .withColumn("_level", F.max_by("_level", F.when(free, F.col("_weights"))).over(everything))
        .withColumn("target", F.coalesce(F.least(size * most, F.col("_level") * F.col("_weight")), size * most).cast("double"))
        .withColumn("_words", F.floor("target"))
        .withColumn("_up_to", F.sum("_words").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_all", F.sum("_words").over(everything))
        .withColumn("hi", F.floor(F.try_divide(F.col("_up_to").cast("double"), F.col("_all").cast("double")) * float(POINTS)))
        .withColumn("lo", F.coalesce(F.lag("hi").over(in_turn), F.lit(0)))
        .select("_source", "n_rows", "source_size", "target", "_place", "lo", "hi", "_total")
    )


def schedule(spark: SparkSession, targets: DataFrame, n_slots: int) -> DataFrame:
    """``slot, _source, block``: each slot's source, and its rank among the source's slots."""
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(POINTS)) * GOLDEN, F.lit(POINTS)).alias("point")
    )
    stretches = targets.where("hi > lo").select(
        "_source", "lo", "hi",
        F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"),
    )
    drawn = (
        slots.withColumn("cell", F.shiftright("point", CELL_BITS))
        .join(stretches, "cell")
        .where("point >= lo AND point < hi")
        .select("slot", "_source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    before = Window.partitionBy("_source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("_source", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_source", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("chunk", "_source").orderBy("slot")) - 1
    return (
        drawn.withColumn("_rank", rank)
        .join(offsets, ["_source", "chunk"])
        .select("slot", "_source", (F.col("_base") + F.col("_rank")).alias("block"))
    )


def shuffled_stream(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``start``: each document's first word in the shuffled stream of its source.

    The order is that of the md5 of the id, so reruns agree. A source is summed up in buckets of
    neighbouring hashes first, so a source with most of the rows is spread over many tasks.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / ROWS_PER_BUCKET))
    rows = sized.join(targets.select("_source", "n_rows", "source_size", "target"), "_source").withColumn("_digest", digest)
    rows = rows.withColumn(
        "_bucket", F.shiftright(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint") * buckets, 32)
    )
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    offsets = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = (
        Window.partitionBy("_source", "_bucket").orderBy("_digest", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_to", F.sum("size").over(inside))
        .join(offsets, ["_source", "_bucket"])
        .withColumn("start", F.col("_base") + F.col("_to") - F.col("size"))
        .drop("_base", "_to", "_digest", "_bucket")
    )


class Mix:
    """A mix of ``docs``; see :func:`mix`. ``stream`` has a row for each document, ``pieces`` one for each part taken."""

    def __init__(self, stream: DataFrame, pieces: DataFrame) -> None:
        self.stream, self.pieces = stream, pieces

    def taken(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, taken``: words taken of each document, repeats counted."""
        words = self.pieces.groupBy("_source", "start").agg(F.sum("n").alias("taken"))
        some = self.stream.where("size > 0").join(words, ["_source", "start"], "left")
        none = self.stream.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
        return some.unionByName(none).select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
        )


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of ``docs``: what the mix is planned from."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mix(
    sized: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK_WORDS,
) -> Mix:
    """Mix the sources of documents given as ``doc_id, source, size`` to ``share`` times all words.

    ``pieces``: ``slot, doc_id, pass, first_word, n`` (and the stream's key): at a place of the mix, so many
    words of a document from ``first_word`` on. A source's words come within a few blocks of its target; no
    document is taken more than ``most`` times over. A document of size 0 is never taken; NULL source is a
    source; repeated rows are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    spark = sized.sparkSession
    sized = materialise(sized.select("doc_id", "source", _named(F.col("source")).alias("_source"), "size"), "mix-sized")
    targets = materialise(source_targets(sized, weights, share, most), "mix-targets")
    total = targets.agg(F.max("_total")).first()[0] or 0
    slots = schedule(spark, targets, round(total * share / block))
    stream = materialise(shuffled_stream(sized, targets), "mix-stream")
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    parts = (
        stream.where("size > 0").select("doc_id", "_source", "start", "size", "source_size", passes)
        .withColumn("_from", F.col("pass") * F.col("source_size") + F.col("start"))
        .withColumn("_end", F.col("_from") + F.col("size"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_end") - 1) / block))))
        .withColumn("_at", F.greatest("_from", F.col("block") * block))
        .withColumn("n", F.least("_end", (F.col("block") + 1) * block) - F.col("_at"))
        .select("_source", "block", "doc_id", "start", "pass", (F.col("_at") - F.col("_from")).alias("first_word"), "n")
    )
    return Mix(stream, slots.join(parts, ["_source", "block"]))


def take_mix(docs: DataFrame, key: Column, **how) -> DataFrame:
    """The documents that the mix takes, once for each pass, with all their columns.

    ``key`` tells documents apart; rows of one key are one document, and the row of least text (then least
    content) stands for it, in the plan and in what is taken alike. A document that the mix takes in part is
    cut out of its own text, from the first taken word to the last, so line breaks and spacing inside stay;
    ``n_chars`` follows the cut text where there is such a column. Columns of any name are carried unchanged.
    """
    names = list(docs.columns)
    doc, k, p, first, n = (fresh(names, b) for b in ("_doc", "_key", "_pass", "_first", "_n"))
    whole_doc = F.col(doc)
    text = whole_doc.getField("text")
    rows = docs.select(key.alias(k), packed(docs, doc))
    # one row per key: partial minimum map-side, so a key with very many rows is summed before the shuffle
    least = F.struct(text.alias("t"), F.sha2(F.to_json(whole_doc), 256).alias("h"))
    one = materialise(rows.groupBy(k).agg(F.min_by(whole_doc, least).alias(doc)), "mix-documents")
    sized = one.select(F.col(k).alias("doc_id"), whole_doc.getField("source").alias("source"), n_words(text).alias("size"))
    plan = mix(sized, **how).pieces.groupBy(F.col("doc_id").alias(k), F.col("pass").alias(p)).agg(
        F.min("first_word").alias(first), F.sum("n").alias(n)
    )
    taken = one.join(plan, k)
    spans = F.regexp_extract_all(text, F.lit(f"([\\x20\\x09-\\x0D]*{N_WORDS_PATTERN})"), F.lit(1))
    part = F.regexp_replace(
        F.array_join(F.slice(spans, (F.col(first) + 1).cast("int"), F.col(n).cast("int")), ""), r"^[\x20\x09-\x0D]+", ""
    )
    whole = F.col(n) >= n_words(text)
    cut = F.when(whole, text).otherwise(part)
    out = whole_doc.withField("text", cut)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withField("n_chars", F.when(whole, whole_doc.getField("n_chars")).otherwise(F.length(cut).cast(kind)))
    return taken.select(out.alias(doc)).select(*[F.col(doc).getField(c).alias(c) for c in names])


def op2_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_documents(table(spark, sf_dir, "documents"))).taken().select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2, 1][place % 3 + 1] AS weight FROM s
), ranked AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         sum(source_size) OVER () AS total
  FROM w
), levels AS (
  SELECT *, (total::DOUBLE * 1.5::DOUBLE - before::DOUBLE * 2) / weights AS lev FROM ranked
), free AS (
  SELECT max_by(lev, weights) AS lev FROM levels WHERE 2 * source_size > lev * weight
), targets AS (
  SELECT l.source, l.place, l.source_size, coalesce(least(2.0::DOUBLE * source_size, f.lev * weight), 2 * source_size)::DOUBLE AS target
  FROM levels l, free f
), cuts AS (
  SELECT *, floor((sum(floor(target)::BIGINT) OVER (ORDER BY place))::DOUBLE / (sum(floor(target)::BIGINT) OVER ())::DOUBLE * {POINTS}.0::DOUBLE)::BIGINT AS hi
  FROM targets
), stretches AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY place), 0) AS lo FROM cuts
), slots AS (
  SELECT ((i % {POINTS}) * {GOLDEN}) % {POINTS} AS point
  FROM range((SELECT round_even(sum(size)::DOUBLE * 1.5::DOUBLE / {BLOCK_WORDS}, 0)::BIGINT FROM d)) r(i)
), n AS (
  SELECT s.*, least(2 * source_size, {BLOCK_WORDS} * (SELECT count(*) FROM slots p WHERE p.point >= s.lo AND p.point < s.hi)) AS reach
  FROM stretches s
), o AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS a FROM d
)
SELECT o.doc_id, o.size, n.source_size, n.target,
       (greatest(0, least(n.reach, a + size) - a) + greatest(0, least(n.reach, n.source_size + a + size) - n.source_size - a))::BIGINT AS taken
FROM o JOIN n ON o.source IS NOT DISTINCT FROM n.source
"""
