"""Requests to a model, rendered as rows; answers come back as a table."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark import constants as C
from claimspark import schemas
from claimspark.functions.numbers import by_key
from claimspark.functions.text import estimated_tokens


def render_prompt(df: DataFrame, template: str, bindings: Mapping[str, Column]) -> DataFrame:
    """Add ``system`` and ``prompt``; an unknown template is an error.

    The template is cut at its placeholders first, so text that happens to contain another
    placeholder is left alone.
    """
    if template not in C.TEMPLATES:
        raise ValueError(f"Unknown template: {template}")
    system, user = C.TEMPLATES[template]
    parts: list[str | Column] = [user]
    for name, value in bindings.items():
        mark = "{" + name + "}"
        parts = [
            piece
            for part in parts
            for piece in (_around(part, mark, value) if isinstance(part, str) else [part])
        ]
    left_open = re.findall(r"\{(\w+)\}", " ".join(p for p in parts if isinstance(p, str)))
    if left_open:
        raise KeyError(f"template {template} needs {left_open}")
    pieces = [F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]
    return df.withColumns({"system": F.lit(system), "prompt": F.concat(*pieces)})


def _around(text: str, mark: str, value: Column) -> list[str | Column]:
    out: list[str | Column] = []
    for i, piece in enumerate(text.split(mark)):
        if i:
            out.append(value)
        out.append(piece)
    return out


def retrieval_query(df: DataFrame, claim_type: str = "claim_type") -> DataFrame:
    """Add ``query_text``; a missing claim type asks for ``other``."""
    return df.withColumn(
        "query_text", F.concat(F.coalesce(F.col(claim_type), F.lit("other")), F.lit(C.QUERY_SUFFIX))
    )


def truncate_text(df: DataFrame, text: str, n: int = C.EMBED_CHARS) -> DataFrame:
    """The input cap of the embedding request: the first ``n`` characters, as ``embed_text``."""
    return df.withColumn("embed_text", F.substring(F.col(text), 1, n))


def estimate_tokens(df: DataFrame, prompt: str, chars_per_token: float = C.CHARS_PER_TOKEN) -> DataFrame:
    """Add ``input_tokens``: an estimate by the length of the text."""
    return df.withColumn("input_tokens", estimated_tokens(F.col(prompt), chars_per_token))


def estimate_cost(
    df: DataFrame, prices: Mapping[str, tuple[float, float]] = C.TOKEN_PRICES, model: str = "model_id"
) -> DataFrame:
    """Add ``cost_usd`` from per-1000-token prices; NULL for a model without a price."""
    price_in = by_key({m: p[0] for m, p in prices.items()}, F.col(model))
    price_out = by_key({m: p[1] for m, p in prices.items()}, F.col(model))
    cost = F.col("input_tokens") / 1000.0 * price_in + F.col("output_tokens") / 1000.0 * price_out
    return df.withColumn("cost_usd", cost)


def join_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join of requests to answers on (document_id, model_id, task).

    A request without an answer, or whose answer carries an error, gets ``run_error``; one that it has already
    stays. A request that was answered more than once takes one answer: one without an error before the others, then
    the largest by content, so that the choice is the same on every run. Only the
    keys of ``requests`` and the columns asked for travel, so keep document text out of it.
    """
    keys = ["document_id", "model_id", "task"]
    has_error = "error" in responses.columns
    answers = responses if has_error else responses.withColumn("error", F.lit(None).cast("string"))
    rest = [c for c in answers.columns if c not in keys]
    good = F.col("error").isNull() & F.col("raw_output").isNotNull()
    one = Window.partitionBy(*keys).orderBy(F.desc(good), *[F.desc(c) for c in rest])
    single = answers.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    joined = requests.join(single.withColumn("_answered", F.lit(True)), keys, "left")
    failed = F.col("_answered").isNull() | F.col("error").isNotNull() | F.col("raw_output").isNull()
    before = F.col("run_error") if "run_error" in requests.columns else F.lit(None).cast("string")
    told = F.coalesce(before, F.when(failed, F.lit(C.MSG_FAILED)))
    return joined.withColumn("run_error", told).drop("_answered", "error")


def infer(
    requests: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    partitions: int | None = None,
) -> DataFrame:
    """Run the user's batch model call over requests; one answer row per request.

    ``fn`` maps batches of requests to batches with ``raw_output, input_tokens,
    output_tokens, latency_seconds``, row for row. A batch on which it raises becomes rows
    with ``error`` filled, so one bad batch does not end the job.

    A ``.str`` accessor, or an error that was caught, holds a batch in a reference cycle. Batches are few objects of
    many bytes, so Python by itself would collect them rarely; they are collected after each batch.
    """
    columns = [c.split()[0] for c in schemas.RESPONSE.split(", ")]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[["document_id", "model_id", "task"]].reset_index(drop=True)
            try:
                answer = pd.concat(list(fn(iter([batch]))), ignore_index=True)
                if len(answer) != len(keys):
                    raise ValueError(f"{len(answer)} answers for {len(keys)} requests")
                out = pd.concat([keys, answer.drop(columns=list(keys), errors="ignore")], axis=1)
                out["error"] = None
            except Exception as problem:  # noqa: BLE001 - every failure becomes data
                out = keys.assign(error=f"{type(problem).__name__}: {problem}")
            out = out.reindex(columns=columns).astype(object)
            yield out.where(out.notna(), None)
            batch = keys = answer = out = None
            gc.collect()

    spread = requests.repartition(partitions) if partitions else requests
    return spread.mapInPandas(call, schemas.RESPONSE)
