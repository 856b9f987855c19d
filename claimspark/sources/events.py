"""Upload events: JSON payloads to document keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark import schemas


def normalise_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``bucket``, ``document_id`` and ``run_error`` from either payload shape.

    With ``Records`` present its first element decides, else the flat fields. A payload
    without a key keeps its row and says so in ``run_error``.
    """
    event = F.from_json(F.col(payload), schemas.EVENT)
    wrapped = F.get(F.col("_e.Records"), F.lit(0))["s3"]
    has_records = F.col("_e.Records").isNotNull()
    key = F.when(has_records, wrapped["object"]["key"]).otherwise(F.col("_e.key"))
    return (
        df.withColumn("_e", event)
        .withColumn("bucket", F.when(has_records, wrapped["bucket"]["name"]).otherwise(F.col("_e.bucket")))
        .withColumn("document_id", F.nullif(key, F.lit("")))
        .withColumn("run_error", F.when(F.col("document_id").isNull(), F.lit(C.MSG_NO_KEY)))
        .drop("_e")
    )


def filter_events(
    df: DataFrame,
    payload: str = "payload",
    source: Sequence[str] = ("aws.s3",),
    detail_type: Sequence[str] = ("Object Created",),
    bucket: Sequence[str] | None = None,
) -> DataFrame:
    """Bus events that match the pattern, with ``bucket`` and ``key`` projected out."""
    detail = F.col("_e.detail")
    matches = F.col("_e.source").isin(*source) & F.col("_e.`detail-type`").isin(*detail_type)
    if bucket is not None:
        matches = matches & detail["bucket"]["name"].isin(*bucket)
    return (
        df.withColumn("_e", F.from_json(F.col(payload), schemas.BUS_EVENT))
        .where(matches)
        .withColumns({"bucket": detail["bucket"]["name"], "key": detail["object"]["key"]})
        .drop("_e")
    )
