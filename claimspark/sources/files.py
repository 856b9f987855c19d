"""Folders of whole files as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.text import fold_newlines, is_image, media_of, safe_key, strip_ws


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, as it lies."""
    return spark.read.parquet(path)


def root_of(spark: SparkSession, path: str) -> str:
    """The folder as a full URI, as Spark names the files below it; a pattern counts up to its first folder."""
    plain = re.split(r"/[^/]*[*?\[{]", path, maxsplit=1)[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(plain)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "file:/", fs.makeQualified(hadoop).toUri().toString()).rstrip("/")


def document_key(root: str) -> Column:
    """Document key of a file: its path below the root, as text. Two files never share one."""
    whole = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    encoded = F.substring(whole, F.lit(len(root) + 2), F.lit(1 << 30))
    # a plus sign stands for itself in a path
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def _below(reader, glob: str | None):
    reader = reader.option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", glob) if glob else reader


def list_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``document_id, n_bytes`` of every file below the folder, sorted by key. Contents are not read.

    Spark itself passes over names that begin with ``_`` or ``.``.
    """
    files = _below(spark.read.format("binaryFile"), glob).load(path)
    return files.select(document_key(root_of(spark, path)).alias("document_id"), F.col("length").alias("n_bytes")).orderBy("document_id")


def scan_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``document_id, document_text, media``: every file below the folder that is no image, UTF-8, newlines folded."""
    files = _below(spark.read, glob).text(path, wholetext=True)
    return (
        files.where(~is_image(F.col("_metadata.file_name")))
        .select(document_key(root_of(spark, path)).alias("document_id"), fold_newlines(F.col("value")).alias("document_text"))
        .withColumn("media", media_of(F.col("document_id")))
    )


def scan_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``document_id, content, media`` of the image files below the folder, as bytes."""
    files = _below(spark.read.format("binaryFile"), glob).load(path)
    return (
        files.where(is_image(F.col("_metadata.file_name")))
        .select(document_key(root_of(spark, path)).alias("document_id"), "content")
        .withColumn("media", media_of(F.col("document_id")))
    )


def scan_policies(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, text`` of the files directly in a folder (sub-folders are not entered)."""
    files = _below(spark.read, None).text(path, wholetext=True)
    key = document_key(root_of(spark, path))
    return files.where(~key.contains("/")).select(key.alias("file_name"), fold_newlines(F.col("value")).alias("text"))


def chunk_paragraphs(df: DataFrame, key: str = "file_name", text: str = "text") -> DataFrame:
    """``file_name, pos, chunk``: paragraphs between blank lines, stripped, empty ones dropped.

    ``pos`` counts the kept paragraphs of a file from 0. The outer form keeps Catalyst from
    splitting every text twice, once only to see whether the list is empty.
    """
    pieces = F.transform(F.split(F.col(text), "\n\n"), strip_ws)
    kept = F.filter(pieces, lambda p: p != "")
    listed = df.select(F.col(key).alias("file_name"), F.posexplode_outer(kept).alias("pos", "chunk"))
    return listed.where(F.col("chunk").isNotNull())


def classify_media(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Add ``media``: text, invoice or photo, from the key."""
    return df.withColumn("media", media_of(F.col(key)))


def source_with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "document_id") -> DataFrame:
    """All primary rows, and the fallback rows whose key the primary lacks.

    The keys are made distinct first: it costs no shuffle beyond the join's own, and copies of
    one key do not pile up in its partition.
    """
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def admit_uploads(
    df: DataFrame, key: str = "file_name", allowed: Sequence[str] = (".txt", ".png", ".jpg", ".jpeg")
) -> DataFrame:
    """Add ``document_id`` (safe key) and ``reject_reason`` (NULL = admitted).

    The suffix test is case-sensitive. Rejected rows stay, with their reason.
    """
    ends = F.lit(False)
    for suffix in allowed:
        ends = ends | F.col(key).endswith(suffix)
    cleaned = safe_key(F.col(key))
    reason = (
        F.when(F.coalesce(F.col(key), F.lit("")) == "", "Empty filename")
        .when(~ends, "File type not allowed")
        .when(cleaned == "", "Unusable filename")
    )
    return df.withColumns({"document_id": F.when(reason.isNull(), cleaned), "reject_reason": reason})
