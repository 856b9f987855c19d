"""Sinks: the result table, JSON export, landing of documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark import schemas
from claimspark.functions.text import media_of
from claimspark.operators.results import ORDER, latest_results


def write_results(df: DataFrame, path: str, batch_id: int, run_id: str = "batch") -> None:
    """Write one batch under ``run_id=<run>/batch_id=<n>/status=<s>/``, replacing what that batch wrote before.

    A replayed batch overwrites exactly its own folder, so delivery may repeat; another stream, or one with a
    new checkpoint, is another run and overwrites nothing. Which write of a document counts is decided on
    reading, by ``latest_results``.
    """
    df.write.mode("overwrite").partitionBy("status").parquet(f"{path}/run_id={run_id}/batch_id={batch_id}")


def stored_results(spark: SparkSession, path: str, schema: str = schemas.RESULT) -> DataFrame:
    """All written batches, with ``run_id`` and ``batch_id``. The schema is stated, so no file is opened for it."""
    return spark.read.schema(f"{schema}, run_id STRING, batch_id BIGINT").option("basePath", path).parquet(path)


def compact_results(stored: DataFrame, new_path: str, order: Sequence[str] = ORDER) -> None:
    """Write the newest row of each document as a table of its own, in which nothing is replaced.

    Readers go on with the old folder until they are pointed to the new one, which keeps run and batch.
    """
    newest = latest_results(stored, order=order)
    newest.write.mode("error").partitionBy("run_id", "batch_id", "status").parquet(new_path)


def write_files(df: DataFrame, path: str, key: str, content: str) -> int:
    """One file per row, named by its key below ``path``; a key may hold folders. Returns the number of files.

    The tasks write through the file system of ``path``. A repeated attempt writes the same file again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        for batch in batches:
            for name, body in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist()):
                target = f"{root}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(body or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def success_rows(results: DataFrame) -> DataFrame:
    """What the success sink stores, the flags, warnings and metrics included."""
    return results.where(F.col("status").isin(C.STATUS_OK, C.STATUS_STORED_OK)).drop("errors", "raw_output", "error")


def invalid_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == C.STATUS_INVALID).select(
        "document_id", "status", "errors", "raw_output"
    )


def failed_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == C.STATUS_FAILED).select("document_id", "status", "error")


def export_results_json(df: DataFrame, path: str) -> None:
    """One JSON object per line and document; NULL fields are left out."""
    df.write.mode("overwrite").json(path)


def land_documents(df: DataFrame, path: str, key: str = "document_id") -> None:
    """Store documents as Parquet by media kind, many per file."""
    df.withColumn("media", media_of(F.col(key))).write.mode("overwrite").partitionBy(
        "media"
    ).parquet(path)
