"""Claims as they arrive: a file stream, processed and stored batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimspark import constants as C
from claimspark.functions.text import fold_newlines, is_image, media_of
from claimspark.sources.files import document_key, root_of
from claimspark.sources.sinks import write_results


LIST_TASKS = 64  # tasks that list folders and files together, or the session's cores where they are more
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def list_by_few_tasks(spark: SparkSession) -> None:
    """Lower the session's number of listing tasks, if it is higher.

    A file stream looks up the files of each batch again, by default with a task for each file, whose report to the
    driver is several times as long as the file's entry. It reads the setting at every batch, so it stays lowered.
    """
    most = max(LIST_TASKS, spark.sparkContext.defaultParallelism)
    if int(spark.conf.get(LISTING)) > most:
        spark.conf.set(LISTING, str(most))


def stream_documents(
    spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 10_000
) -> DataFrame:
    """Stream of ``document_id, document_text, media, run_error``; each new file below the folder is one row.

    The key is the path below the folder. An image has no text here; its row says so in ``run_error``, so it
    ends as a failure and does not vanish.
    """
    reader = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    list_by_few_tasks(spark)
    files = reader.text(path, wholetext=True)
    image = is_image(F.col("_metadata.file_name"))
    return files.select(
        document_key(root_of(spark, path)).alias("document_id"),
        F.when(~image, fold_newlines(F.col("value"))).alias("document_text"),
        F.when(image, F.lit(C.MSG_NO_TEXT)).alias("run_error"),
    ).withColumn("media", media_of(F.col("document_id")))


def upsert_to(path: str, process: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """The batch step: process, then store under the folder of the stream and the batch.

    A stream keeps its id as long as its checkpoint; another stream has another. Statuses are split by the
    partitioned write itself, in one pass over the batch. Documents that arrive again are processed again; the
    newest write wins on reading, so nothing is dropped as a duplicate here.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_results(process(batch), path, batch_id, stream or "batch")

    return write


def upsert_stream(
    docs: DataFrame,
    out_path: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream over any streaming documents. The default trigger handles what is there and stops."""
    return (
        docs.writeStream.foreachBatch(upsert_to(out_path, process))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_claims(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    glob: str | None = None,
    trigger: dict | None = None,
    files_per_trigger: int = 10_000,
) -> StreamingQuery:
    """Claims dropped as files below ``in_path``, processed into the result table at ``out_path``."""
    docs = stream_documents(spark, in_path, glob, files_per_trigger)
    return upsert_stream(docs, out_path, checkpoint, process, trigger)
