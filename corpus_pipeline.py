"""Raw documents to shards: language, near duplicates, benchmark leaks, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result as
Parquet and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import fresh, packed, table
from claimspark.llm.decontaminate import find_leaks
from claimspark.llm.langid import keep_identified
from claimspark.llm.minhash import near_duplicates
from claimspark.llm.mixing import take_mix
from claimspark.llm.sharding import shard_by_bytes
from claimspark.session import materialise

NO_ID = 1 << 62     # documents without an id come after all others


def _key() -> Column:
    """The id, or one made from the text where there is none."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network tells; NULL texts and texts without a letter go."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows of one id leave one.

    NULL and empty texts are duplicates of nothing. A document without an id goes where one with an id is like it.
    Of several rows of one id, the one of least text, then least content, stays. Columns of any name are carried.
    """
    names = list(docs.columns)
    doc, key, text = fresh(names, "_doc"), fresh(names, "_key"), fresh(names, "_text")
    keyed = docs.select(_key().alias(key), F.col("text").alias(text), packed(docs, doc))
    kept = near_duplicates(keyed.select(key, text), key=key, text=text).where("kept").select(F.col("doc_id").alias(key)).distinct()
    # one row per id, chosen by content and summed map-side, so an id with very many rows makes no hot task
    least = F.struct(F.col(text).alias("t"), F.sha2(F.to_json(F.col(doc)), 256).alias("h"))
    one = keyed.join(kept, key, "left_semi").groupBy(key).agg(F.min_by(F.col(doc), least).alias(doc))
    return one.select(*[F.col(doc).getField(c).alias(c) for c in names])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. NULL and empty texts stay."""
    names = {f"_c{i}": c for i, c in enumerate(docs.columns)}     # whatever the columns are called
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col("text"))
    clean = find_leaks(renamed, table(spark, sf_dir, "benchmark"), keep=list(names)).where(F.size("hits") == 0)
    return clean.select(*[F.col(n).alias(c) for n, c in names.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of the sources, a row for each time that a document is taken; rows of an id are one document."""
    return take_mix(docs, _key())


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row."""
    return shard_by_bytes(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
