"""Retrieval of policy passages: exact top-k by vector, or by weighted terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark.functions.text import has_words, words
from claimspark.functions.vectors import cosine_block, norm
from claimspark.operators.skew import is_small, lookup_join
from claimspark.session import fresh_path, materialise

QUERY_BLOCK = 512  # query vectors held by one task at a time


def vector_norms(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add ``vector_norm``, the Euclidean length in double precision."""
    return df.withColumn("vector_norm", norm(F.col(vector)))


def similarity_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = C.TOP_K,
    order: Sequence[str] = ("file_name", "pos"),
    vector: str = "embedding",
    query_id: str = "query_id",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` most similar corpus rows of each query: ``query_id, *order, similarity, rank``.

    Exact: every corpus vector meets every query vector, as matrix products inside one scan of
    the corpus. The queries lie in the shared folder, and a task reads them ``block`` at a time against
    each batch of its own, so neither the driver nor a task holds them all. What leaves a task is at most ``k``
    rows per batch and query. Equal similarities rank by ``order``. Vectors that are NULL, hold a NULL, or
    have another length than most queries take no part.
    """
    order = list(order)
    fields = {f.name: f.dataType.simpleString() for f in corpus.schema}
    out_schema = ", ".join(
        [f"{query_id} {dict(queries.dtypes)[query_id]}"]
        + [f"{c} {fields[c]}" for c in order]
        + ["similarity double"]
    )
    path = fresh_path(corpus.sparkSession, "query-vectors")
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    numbers = F.col(vector).cast("array<double>").alias(vector)
    queries.where(whole).select(query_id, numbers).write.parquet(path)
    size = corpus.sparkSession.read.parquet(path).agg(F.mode(F.size(vector))).first()[0]
    narrow = corpus.where(whole & (F.size(vector) == F.lit(size))).select(*order, numbers)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            # in the order that decides between equals
            batch = batch.sort_values(order, ignore_index=True)
            rows = np.stack(batch[vector].to_numpy())
            for ids, asked in _stored_vectors(path, query_id, vector, size, block):
                sims = cosine_block(rows, asked)
                top = np.argsort(-sims, axis=0, kind="stable")[:k]
                found = batch[order].iloc[top.T.ravel()].reset_index(drop=True)
                found.insert(0, query_id, pd.Series(ids, dtype=object).repeat(len(top)).reset_index(drop=True))
                found["similarity"] = np.take_along_axis(sims, top, axis=0).T.ravel()
                yield found

    return rank_topk(narrow.mapInPandas(best, out_schema), k, query_id, order)


def _stored_vectors(path: str, query_id: str, vector: str, size: int, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of a stored table, ``block`` rows at a time."""
    from pyarrow import fs, parquet

    system, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    for info in system.get_file_info(fs.FileSelector(root)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for rows in parquet.ParquetFile(file).iter_batches(block):
                    kept = [(i, v) for i, v in zip(rows[query_id].to_pylist(), rows[vector].to_pylist()) if len(v) == size]
                    if kept:
                        yield [i for i, _ in kept], np.array([v for _, v in kept], dtype=np.float64)


def rank_topk(scored: DataFrame, k: int, query_id: str, order: Sequence[str]) -> DataFrame:
    """Keep ``rank <= k`` per query. Spark cuts each task's share to k before the shuffle."""
    best_first = Window.partitionBy(query_id).orderBy(F.desc("similarity"), *order)
    return scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def term_weights(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """Add ``terms`` (term and weight 1+ln tf, one entry per distinct term) and ``term_norm``.

    Counting runs inside the row, over the sorted words of one chunk: no explode, no shuffle.
    """
    tokens = F.col("_tokens")
    n = F.size(tokens)
    last_of_run = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(tokens, i) != F.get(tokens, i - 1))
    )
    none = F.array().cast("array<int>")
    counted = F.zip_with(
        F.col("_ends"),
        F.slice(F.concat(F.array(F.lit(0)), F.col("_ends")), 1, F.size("_ends")),
        lambda end, start: F.struct(
            F.get(tokens, end - 1).alias("term"),
            (F.lit(1.0) + F.log((end - start).cast("double"))).alias("weight"),
        ),
    )
    length = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["weight"] * t["weight"])
    return (
        chunks.withColumn("_tokens", F.sort_array(words(F.col(text))))
        .withColumn("_ends", F.when(n > 0, last_of_run).otherwise(none))
        .withColumn("terms", counted)
        .withColumn("term_norm", F.sqrt(length))
        .drop("_tokens", "_ends")
    )


def _entries(chunks: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``*keys, term_norm, term, weight``, a row per term of a chunk.

    Exploded as outer, with the empty rows dropped afterwards: for a plain explode Catalyst
    derives a filter on the exploded list and counts all terms a second time to evaluate it.
    """
    listed = term_weights(chunks, text).select(*keys, "term_norm", F.explode_outer("terms").alias("t"))
    return listed.where(F.col("t").isNotNull()).select(
        *keys, "term_norm", F.col("t.term").alias("term"), F.col("t.weight").alias("weight")
    )


def tfidf_retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = C.TOP_K,
    order: Sequence[str] = ("file_name", "pos"),
    text: str = "chunk",
    query_text: str = "query_text",
    query_id: str = "query_id",
) -> DataFrame:
    """Lexical stand-in for embeddings: ``query_id, *order, similarity, rank``.

    Chunks weigh a term 1+ln(tf), queries additionally idf = ln(1 + N/df); similarity is the
    cosine of the two (the lnc.ltc scheme). As idf sits on the query side alone, only terms
    that a query names leave the corpus scan; they are written once and read for df and for
    the products. Chunks that share no term with a query are not returned for it.
    """
    order = list(order)
    asked = _entries(queries.select(query_id, F.col(query_text).alias(text)), [query_id], text)
    asked = materialise(asked.select(query_id, "term", F.col("weight").alias("query_tf")), "asked-terms")
    spread = F.concat_ws("/", *[F.col(c).cast("string") for c in order])
    named = asked.select("term").distinct()
    entries = _entries(chunks.select(*order, text), order, text)
    hits = materialise(lookup_join(entries, named, "term", spread, "left_semi"), "term-hits")
    total = chunks.where(has_words(F.col(text))).agg(F.count(F.lit(1))).first()[0]
    idf = hits.groupBy("term").agg(F.log(F.lit(1.0) + F.lit(float(total)) / F.count(F.lit(1))).alias("idf"))
    weighted = asked.join(idf, "term").withColumn("query_weight", F.col("query_tf") * F.col("idf"))
    # terms no chunk holds have no idf and weigh nothing on either side
    lengths = weighted.groupBy(query_id).agg(
        F.sqrt(F.sum(F.col("query_weight") * F.col("query_weight"))).alias("query_norm")
    )
    weighted = materialise(
        weighted.join(lengths, query_id).select(query_id, "term", "query_weight", "query_norm"), "query-terms"
    )
    product = F.col("weight") * F.col("query_weight") / (F.col("term_norm") * F.col("query_norm"))
    scored = (
        lookup_join(hits, weighted, "term", spread, "inner")
        .groupBy(query_id, *order)
        .agg(F.round(F.sum(product), 9).alias("similarity"))
    )
    return rank_topk(scored, k, query_id, order)


def policy_context(topk: DataFrame, chunks: DataFrame, query_id: str = "query_id", order: Sequence[str] = ("file_name", "pos")) -> DataFrame:
    """``query_id, context``: the ranked passages joined best first. A group holds k rows."""
    order = list(order)
    chosen = topk.select(query_id, *order, "rank")
    found = chunks.select(*order, "chunk").join(
        F.broadcast(chosen) if is_small(chosen) else chosen, order
    )
    return found.groupBy(query_id).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda s: s["chunk"]),
            C.CONTEXT_SEPARATOR,
        ).alias("context")
    )


def attach_context(claims: DataFrame, contexts: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    """Add ``context`` by claim type. ``contexts`` has one row per type in ``query_id``.

    Retrieval ran once per distinct type, not per claim. Few types means the claims are never
    shuffled; a long tail of types falls back to a salted join, as a type may own most claims.
    """
    by_type = contexts.select(F.col("query_id").alias("_type"), "context")
    typed = claims.withColumn("_type", F.coalesce(F.col("claim_type"), F.lit("other")))
    extra = {} if rows_per_slice is None else {"rows": 0, "rows_per_slice": rows_per_slice}
    return lookup_join(typed, by_type, "_type", F.col("document_id"), "left", **extra).drop("_type")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: ``n_chunks, n_files``; fails when there is nothing to retrieve from."""
    counted = chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("file_name").alias("n_files")
    )
    checked = F.when(F.col("n_chunks") == 0, F.raise_error(F.lit("No policy documents found"))).otherwise(
        F.col("n_chunks")
    )
    return counted.select(checked.cast("bigint").alias("n_chunks"), "n_files")
