"""Checks of claims against history: duplicate bills by a hash tree, the policy version in force, equal amounts.

Duplicate bills (the roadmap's "metadata hashing"): a bill's normalised line items are hashed, the sorted
line hashes of a section give the section hash, the sorted section hashes the bill hash. Equal parts of
unlike bills thus have equal section hashes. History is a stored index with one row per hash, its first
bill; every bill is probed against it by a join on the hash. Bills that share a hash are never paired:
a hash held by a third of all bills is one row of the index, summed map-side.

Policy in force: an as-of join of claims to policy versions, without a range product. Rows of both are
unioned and sorted within (policy, month); the last version at or before a claim is a running
``last(ignorenulls)``. What a month inherits comes from a second running window over the versions and
one marker per (policy, month), so a policy with a third of all claims is spread over its months.

Equal amounts: one row per amount that claims of more than one policy ask for, not pairs of claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sorted_hash(values: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(values))), 256)


FAR = "9999-12-31"  # the day of a bill without one


def hash_tree(lines: DataFrame, bill: str, section: str, line: Column) -> tuple[DataFrame, DataFrame]:
    """Section hashes ``bill, section, section_hash`` and bills ``bill, n_lines, n_sections, bill_hash``.

    ``line`` is the normalised text of a line item; a NULL line counts as the empty text, a NULL section
    as the section ''. Repeated equal lines count each time.

    The short texts of the lines travel, once and by bill; every hash is made where the bill lies.
    """
    texts = lines.select(
        F.col(bill).alias("bill"), F.coalesce(F.col(section).cast("string"), F.lit("")).alias("section"),
        F.coalesce(line, F.lit("")).alias("line"),
    ).repartition("bill")
    sections = texts.groupBy("bill", "section").agg(
        _sorted_hash(F.sha2("line", 256)).alias("section_hash"), F.count("*").alias("n_lines")
    )
    bills = sections.groupBy("bill").agg(
        F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_sections"),
        _sorted_hash(F.concat(F.col("section"), F.lit(":"), F.col("section_hash"))).alias("bill_hash"),
    )
    return sections, bills


def history_index(rows: DataFrame, hash_col: str, order: list[str], bill: str = "bill") -> DataFrame:
    """One row per hash: the first bill (by ``order``, then bill) that holds it, as ``first_*`` columns."""
    first = F.min(F.struct(*[F.col(c) for c in order], F.col(bill))).alias("first")
    return rows.groupBy(hash_col).agg(first).select(
        hash_col, *[F.col(f"first.{c}").alias(f"first_{c}") for c in [*order, bill]]
    )


def duplicate_bills(sections: DataFrame, bills: DataFrame, dates: DataFrame, date: str) -> DataFrame:
    """Per bill: ``first_bill`` with its bill hash, ``duplicate`` (an earlier bill has it) and ``n_shared_sections``.

    Earlier means a smaller (``date``, bill); ``dates`` holds ``bill`` and ``date``. A bill without a date
    comes after all dated ones.
    """
    far = F.lit(FAR).cast("timestamp")
    when = dates.select("bill", F.coalesce(F.col(date).cast("timestamp"), far).alias("at"))
    at = F.coalesce("at", far).alias("at")
    # hashes travel as 32 bytes
    b = bills.join(when, "bill", "left").select("bill", at, "n_lines", "n_sections", F.unhex("bill_hash").alias("_key"))
    s = sections.join(when, "bill", "left").select("bill", at, F.unhex("section_hash").alias("_key"))
    # a bill shares the sections that it is not first with: all of its own, once for each of its dates, less the others
    per = s.groupBy("bill", "_key").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    first = per.groupBy("_key").agg(F.min(F.struct("at", "bill", "n")).alias("first"))
    unshared = first.select("first.bill", "first.n").where(F.col("bill").isNotNull())
    if not bills.where(F.col("bill").isNull()).isEmpty():
        # no bill shares a section whose first bill has no key; such a bill is first among undated ones only
        keyless = first.where(F.col("first.bill").isNull()).select("_key")
        unshared = unshared.unionByName(
            per.where((F.col("at") >= far) & F.col("bill").isNotNull()).join(keyless, "_key", "left_semi").select("bill", "n")
        )
    unshared = unshared.groupBy("bill").agg(F.sum("n").alias("_unshared"))
    times = dates.groupBy("bill").agg(F.count("*").alias("_times"))
    shared = F.col("n_sections") * F.coalesce("_times", F.lit(1)) - F.coalesce("_unshared", F.lit(0))
    counted = b.join(times, "bill", "left").join(unshared, "bill", "left").select(
        "bill", "at", "n_lines", "n_sections", "_key",
        F.when(F.col("bill").isNotNull(), shared).otherwise(0).cast("bigint").alias("n_shared_sections"),
    )
    return counted.join(history_index(b, "_key", ["at"]), "_key").select(
        "bill", "n_lines", "n_sections", F.lower(F.hex("_key")).alias("bill_hash"), "first_bill",
        (F.col("first_bill") != F.col("bill")).alias("duplicate"), "n_shared_sections",
    )


_FOUND = "struct<version:int,activated:date>"


def version_in_force(claims: DataFrame, versions: DataFrame, key: str, date: str, at: str, version: str) -> DataFrame:
    """Each claim with ``version`` and ``activated`` of the last version of its ``key`` activated on or before ``date``.

    ``claims`` has ``key`` and ``date``; ``versions`` has ``key``, ``at`` (activation date) and ``version``.
    A version activated on the claim's day is in force. Claims before every version, or with a NULL key or
    date, get NULLs. Two versions of one key on one day: the greater version wins.
    """
    month = lambda c: F.date_trunc("month", c.cast("timestamp"))
    claim = F.struct(*[F.col(n) for n in claims.columns])
    v = versions.select(
        F.col(key).alias("_key"), F.col(at).cast("date").alias("_day"), F.col(version).alias("_version")
    ).where(F.col("_key").isNotNull() & F.col("_day").isNotNull())
    # the claims travel whole through the window, so nothing is joined back to them
    rows = claims.select(
        claim.alias("_claim"), F.col(key).alias("_key"), F.col(date).cast("date").alias("_day"), F.lit(1).alias("_kind"),
        F.lit(None).cast(_FOUND).alias("_found"),
    )
    vrows = v.select(
        F.lit(None).cast(rows.schema["_claim"].dataType).alias("_claim"), "_key", "_day", F.lit(0).alias("_kind"),
        F.struct(F.col("_version").cast("int").alias("version"), F.col("_day").alias("activated")).alias("_found"),
    )
    # within (key, month): versions sort before the claims of their day
    both = rows.unionByName(vrows).withColumn("_month", month(F.col("_day")))
    running = Window.partitionBy("_key", "_month").orderBy("_day", "_kind", "_found.version").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = both.withColumn("_in", F.last("_found", ignorenulls=True).over(running)).where(F.col("_kind") == 1)
    # what each (key, month) of the claims inherits from earlier months
    marks = inside.select("_key", "_month").distinct().select(
        "_key", F.col("_month").cast("date").alias("_day"), F.lit(0).alias("_kind"), F.lit(None).cast(_FOUND).alias("_found")
    )
    history = marks.unionByName(vrows.select("_key", "_day", F.lit(1).alias("_kind"), "_found"))
    before = Window.partitionBy("_key").orderBy("_day", "_kind", "_found.version").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = (
        history.withColumn("_carry", F.last("_found", ignorenulls=True).over(before))
        .where(F.col("_kind") == 0)
        .select("_key", F.col("_day").cast("timestamp").alias("_month"), "_carry")
    )
    got = F.coalesce("_in", "_carry")
    return inside.join(carried, ["_key", "_month"], "left").select(
        "_claim.*", got["version"].alias("version"), got["activated"].alias("activated")
    )


def shared_amounts(claims: DataFrame, amount: str, key: str, claim: str) -> DataFrame:
    """One row per amount asked on more than one ``key``: ``n_claims``, ``n_policies``, ``first_claim``.

    Claims with a NULL amount or key are left out.
    """
    per = claims.where(F.col(amount).isNotNull() & F.col(key).isNotNull()).groupBy(amount, key).agg(
        F.count("*").alias("n"), F.min(claim).alias("first")
    )
    return (
        per.groupBy(amount)
        .agg(F.sum("n").alias("n_claims"), F.count("*").alias("n_policies"), F.min("first").alias("first_claim"))
        .where(F.col("n_policies") > 1)
    )
