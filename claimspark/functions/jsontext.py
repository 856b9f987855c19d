"""Strict reading of one JSON object held in a string column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def strict_object(df: DataFrame, text: str, fields: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: ``values`` (a string per field) and ``keys`` of a JSON object in ``text``.

    NULL unless the whole text is exactly one object. The plain parser stops at the first
    complete value and so accepts trailing text. Two wrappings close that gap: as the only
    element of an array and as the only member of an object; text that ends a wrapper early
    cannot satisfy both. The array reading gives the values (the last one of a repeated name),
    the member reading the names. Each is a column of its own, so each is parsed once.
    """
    element = "array<struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">>"
    only = F.get(F.col("_element"), F.lit(0))
    inner = F.try_element_at(F.col("_member"), F.lit("w"))
    whole = (F.size("_element") == 1) & only.isNotNull() & (F.size("_member") == 1) & inner.isNotNull()
    return (
        df.withColumns(
            {
                "_element": F.from_json(F.concat(F.lit("["), F.col(text), F.lit("]")), element, _STRICT),
                "_member": F.from_json(
                    F.concat(F.lit('{"w":'), F.col(text), F.lit("}")), "map<string,map<string,string>>", _STRICT
                ),
            }
        )
        .withColumn(out, F.when(whole, F.struct(only.alias("values"), F.map_keys(inner).alias("keys"))))
        .drop("_element", "_member")
    )


def boolean_field(text: Column, name: str) -> Column:
    """The field as a JSON boolean, NULL for any other JSON type (also for quoted text)."""
    return F.from_json(text, f"`{name}` BOOLEAN", _STRICT)[name]
