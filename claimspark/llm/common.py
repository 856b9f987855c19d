"""What the operators share: table access, slices of a batch, and hashed words of whole texts.

Word hashes are 64 bits wide. They depend on the word alone, so tasks on different machines
agree without any shared state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20      # text handled at once inside a task
_SEED = 20240229
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(_SEED)
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def char_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """256 flags: bytes that belong to a word, that is lie in none of the ranges."""
    inside = np.ones(256, dtype=bool)
    for first, last in outside:
        inside[first : last + 1] = False
    return inside


NOT_SPACE = char_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = char_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
N_WORDS_PATTERN = r"[^\x20\x09-\x0D]+"


def process_cache(name: str) -> dict:
    """A dictionary that lasts as long as this Python process.

    The package's functions travel to workers with their code and globals, so a global of a module would be
    sent along with each of them and forgotten with each task.
    """
    return sys.__dict__.setdefault("_claimspark_cache", {}).setdefault(name, {})


def fresh(names: list[str], base: str) -> str:
    """A column name like ``base`` that none of ``names`` has."""
    name, n = base, 0
    while name in names:
        n += 1
        name = f"{base}{n}"
    return name


def packed(docs: DataFrame, name: str) -> Column:
    """All columns of ``docs`` as one struct, whatever they are called."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space) as a long; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(N_WORDS_PATTERN)), F.lit(0)).cast("bigint")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the splitmix64 finaliser)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, at least ``n`` of each."""
    known = process_cache("powers")
    if "up" not in known or len(known["up"]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            known[name] = np.cumprod(steps, dtype=np.uint64)
    return known["up"], known["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``S`` such that ``span_hash(S, a, b)`` identifies the bytes ``data[a:b]``."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash alike wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


class Words(NamedTuple):
    hashes: np.ndarray     # of each word
    offsets: np.ndarray    # words of text i: offsets[i] to offsets[i + 1]
    starts: np.ndarray     # byte positions in data
    ends: np.ndarray
    data: np.ndarray       # the lower-cased bytes, texts apart by one space


def words_of(texts: list[bytes | None], inside: np.ndarray = NOT_SPACE) -> Words:
    """Words of whole texts with A-Z lower-cased. A NULL text has no words."""
    texts = [t or b"" for t in texts]
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = inside[data]
    edges = np.diff(flags)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = span_hash(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    return Words(hashes, np.searchsorted(starts, bounds), starts, ends, data)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring words (``len - n + 1`` of them)."""
    n = int(n)
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + m] * np.uint64(pow(int(_BASE), n - 1 - k, 2**64))
    return mix(total + np.uint64(n))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, NULL kept."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        sizes = np.array(
            pc.fill_null(pc.binary_length(column), 0).to_pylist(), dtype=np.int64
        )
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        first = 0
        for cut in [*cuts.tolist(), batch.num_rows]:
            if cut > first:
                yield batch.slice(first, cut - first)
                first = cut


def drawn(by: Column, wanted: int, rows: int | Column) -> Column:
    """Whether a row is in a sample of about twice ``wanted`` of ``rows`` rows, by a hash of ``by``.

    What is then ordered and cut to ``wanted`` rows does not grow with the table.
    """
    return F.shiftrightunsigned(F.xxhash64(by), 11) / float(1 << 53) * (rows if isinstance(rows, Column) else F.lit(rows)) < 2.0 * wanted


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id is as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: DuckDB has no crc32: a table of the 256 steps, and the sum of a text's UTF-8 bytes by it (NULL stays NULL).
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n::BIGINT, list_transform(range(8), lambda z: 0::BIGINT)),
    lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS steps
)"""


def crc32_sql(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (
        f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
        "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) END"
    )
