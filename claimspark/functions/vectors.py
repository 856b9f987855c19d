"""Vector arithmetic: Column form for single rows, numpy form for blocks inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_block(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(rows x queries) cosine similarities in float64, 0 where a norm is 0.

    Rounded to 12 places so that equal vectors tie exactly wherever they sit in a block.
    """
    scale = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    raw = rows @ queries.T
    return np.round(np.divide(raw, scale, out=np.zeros_like(raw), where=scale > 0), 12)
