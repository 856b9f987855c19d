"""Numeric readings of text values."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions.text import strip_ws

# What counts as a number in a model answer.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = (
    rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
)
# decimal digits of other scripts and their ASCII forms, from the Unicode tables
_OTHER_DIGITS = [c for c in map(chr, range(0x660, 0x1FC00)) if unicodedata.decimal(c, None) is not None]
_AS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)
NON_FINITE = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def to_number(raw: Column) -> Column:
    """Double of a text, NULL when it is not a number.

    A cast alone would take ``1d`` and refuse ``1_000``, hence the pattern in front.
    """
    text = F.translate(strip_ws(raw), "".join(_OTHER_DIGITS), _AS_ASCII)
    shaped = text.rlike(NUMBER) | text.rlike(NON_FINITE)
    return F.when(shaped, F.regexp_replace(text, "_", "").try_cast("double"))


def by_key(table: dict[str, float], key: Column, default: float | None = None) -> Column:
    """Look a key up in a small fixed table, as a CASE expression."""
    out = None
    for name, value in table.items():
        branch = (key == F.lit(name), F.lit(value))
        out = F.when(*branch) if out is None else out.when(*branch)
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))
