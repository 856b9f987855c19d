"""Text functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark import constants as C


# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
JSON_SPACE = " \t\n\r"


def strip_ws(col: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` alone takes spaces only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def fold_newlines(col: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_code_fence(col: Column) -> Column:
    """Drop Markdown fences from a model answer that starts with one; strip in any case."""
    bare = strip_ws(col)
    # (?d): only \n ends a line, as the line anchors must not react to \r or U+0085
    unfenced = strip_ws(F.regexp_replace(bare, r"(?md)^```(json)?|```$", ""))
    return F.when(bare.startswith("```"), unfenced).otherwise(bare)


def is_image(key: Column) -> Column:
    return F.lower(key).rlike(r"\.(png|jpg|jpeg)$")


def media_of(key: Column) -> Column:
    """``invoice`` or ``photo`` for image keys, ``text`` for the rest."""
    image = is_image(key)
    return (
        F.when(image & F.lower(key).contains("invoice"), "invoice")
        .when(image, "photo")
        .otherwise("text")
    )


def safe_key(name: Column) -> Column:
    """File name reduced to ``[A-Za-z0-9_.-]``: path parts and blanks become ``_``."""
    flat = F.regexp_replace(F.regexp_replace(name, r"[/\\]", " "), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(flat, r"[^A-Za-z0-9_.\-]", ""), r"^[._]+|[._]+$", "")


def clean_code(key: Column) -> Column:
    """Display code of a key: first ``.txt``, ``.png`` and ``claim_`` removed, upper case."""
    for part in (r"\.txt", r"\.png", "claim_"):
        key = F.regexp_replace(key, rf"(?s)^(.*?){part}", "$1")
    return F.upper(key)


def figures(col: Column) -> Column:
    """Distinct figures of a text, with digit-group commas removed."""
    found = F.regexp_extract_all(col, F.lit(r"\d[\d,]*(?:\.\d+)?"), 0)
    return F.array_distinct(F.transform(found, lambda f: F.regexp_replace(f, ",", "")))


WORD = r"[\p{L}\p{N}]+"


def has_words(col: Column) -> Column:
    """Whether :func:`words` finds any; stops at the first."""
    return col.rlike(WORD)


def words(col: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), 0)


def format_inr(amount: Column) -> Column:
    """Indian digit grouping (``1,45,000``) with up to three decimals, zeros dropped.

    An amount too large for that, or not finite, is shown as it is.
    """
    plain = F.round(amount.try_cast("decimal(35,6)"), 3).try_cast("decimal(32,3)").cast("string")
    whole = F.regexp_replace(
        F.substring_index(plain, ".", 1), r"(?<=\d)(?=(\d\d)*\d{3}$)", ","
    )
    tail = F.regexp_replace(F.concat(F.lit("."), F.substring_index(plain, ".", -1)), r"\.?0+$", "")
    return F.coalesce(F.concat(whole, tail), amount.cast("string"))


def estimated_tokens(text: Column, chars_per_token: float = C.CHARS_PER_TOKEN) -> Column:
    """Length over characters per token, rounded up."""
    return F.ceil(F.length(text) / F.lit(chars_per_token)).cast("bigint")
