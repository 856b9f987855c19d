"""Which documents contain which of very many needles, as an equi-join.

Substring tests of every needle against every document do not scale. Here each document is
cut, inside its task, into windows of the needles' lengths; windows whose hash no needle has
are dropped at once, by a bitmap that grows with the needles. The few that remain are plain strings,
and equality decides. Nothing is approximate: the bitmap only ever keeps too much. Needles beyond what one
bitmap holds at full selectivity go into hash groups, each with a bitmap and a scan of its own.

Needles of many lengths share a few prefix lengths (powers of two). Every position is tested
for those prefixes only; the full lengths are tested where a prefix was found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS = 1 << 20
MAX_BITS = 1 << 29        # 64 MiB on a worker; more needles are worked through in groups
BITS_PER_NEEDLE = 64
BUCKET_BITS = 32768       # bits per row of Spark's bitmap aggregate
BLOCK_BYTES = 1 << 18     # text hashed at a time; blocks overlap by the longest needle
BATCH_BYTES = 1 << 24     # text scanned at once, at least one document
LONGEST_PREFIX = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _window_hashes(data: np.ndarray, sums: np.ndarray, scale: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` bytes; wraps modulo 2**64 by design."""
    n = len(data) - length + 1
    return _mix((sums[length:] - sums[:n]) * scale[:n] + np.uint64(length))


def _prefix_sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums


def _bit_positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _hash_texts(texts: list[bytes]) -> np.ndarray:
    """Hash of each whole text, equal to the hash of a window with the same bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sums = _prefix_sums(data, _powers(_BASE, len(data) + 1))
    scale = _powers(_INVERSE, len(data) + 1)
    return _mix((sums[ends] - sums[starts]) * scale[starts] + sizes.astype(np.uint64))


def _prefix_size(length: int) -> int:
    return min(LONGEST_PREFIX, 1 << (length.bit_length() - 1))


def _needle_bitmap(needles: DataFrame, bits: int) -> np.ndarray:
    """Two bits of each needle and two of its prefix; at most ``bits / 8`` bytes reach the driver."""

    @F.pandas_udf("array<bigint>")
    def own_bits(texts: pd.Series) -> pd.Series:
        whole = [t.encode("utf-8") for t in texts]
        starts = [t[: _prefix_size(len(t))] for t in whole]
        four = [*_bit_positions(_hash_texts(whole), bits), *_bit_positions(_hash_texts(starts), bits)]
        return pd.Series((np.stack(four, axis=1).astype(np.int64) + 1).tolist())

    rows = (
        needles.select(F.explode(own_bits("needle")).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
        .collect()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        start = (row["bucket"] - 1) * (BUCKET_BITS // 8)
        out[start : start + BUCKET_BITS // 8] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return out


def _whole_text(raw: bytes) -> str | None:
    """The window as text; None where it starts or ends inside a character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def needle_hits(needles: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, needle``: candidate containments, distinct within a document.

    ``needles`` holds distinct lower-case strings in ``needle``. Every true containment is in
    the answer; a few others are too, and fall away in any later join on ``needle``.
    """
    groups = -(-needles.where(F.octet_length("needle") > 0).count() * BITS_PER_NEEDLE // MAX_BITS)
    hits = [
        _group_hits(needles.where(F.pmod(F.xxhash64("needle"), F.lit(groups)) == g), texts, key, text)
        for g in range(groups)
    ]
    return reduce(DataFrame.unionByName, hits) if hits else _group_hits(needles.where(F.lit(False)), texts, key, text)


def _by_bytes(batches: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """Cut batches so that each holds about ``BATCH_BYTES`` of text, whatever size they come in.

    No ``.str`` accessor: it ties a batch into a reference cycle, and batches pile up until Python looks for cycles.
    """
    for batch in batches:
        part_of = np.cumsum([len(t) if t is not None else 0 for t in batch[text]]) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1), len(batch)]
        for start, end in zip(cuts, cuts[1:] if len(batch) else []):
            yield batch.iloc[start:end].reset_index(drop=True)


def _group_hits(needles: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """The hits of as many needles as one bitmap holds."""
    spark = texts.sparkSession
    sizes = (
        needles.groupBy(F.octet_length("needle").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    out_schema = f"{key} {dict(texts.dtypes)[key]}, needle string"
    lengths = sorted(r["size"] for r in sizes if r["size"])
    if not lengths:
        return spark.createDataFrame([], out_schema)
    total = sum(r["n"] for r in sizes)
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (total * BITS_PER_NEEDLE - 1).bit_length()))
    shared = spark.sparkContext.broadcast(_needle_bitmap(needles, bits))
    longest = lengths[-1]
    by_prefix = {}
    for length in lengths:
        by_prefix.setdefault(_prefix_size(length), []).append(length)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        powers = _powers(_BASE, BLOCK_BYTES + longest)
        scale = _powers(_INVERSE, BLOCK_BYTES + longest)

        def passing(h: np.ndarray) -> np.ndarray:
            """Indexes of the hashes whose two bits are both set."""
            first, second = _bit_positions(h, bits)
            at = np.nonzero(bitmap[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1)[0]
            second = second[at]
            return at[bitmap[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8) & 1 == 1]

        for batch in _by_bytes(batches, text):
            encoded = [t.encode("utf-8") if t is not None else b"" for t in batch[text]]
            stream = b"".join(encoded)
            ends = np.cumsum([len(e) for e in encoded])
            data = np.frombuffer(stream, dtype=np.uint8)
            found: set[tuple[int, bytes]] = set()
            for start in range(0, len(data), BLOCK_BYTES):
                block = data[start : start + BLOCK_BYTES + longest - 1]
                sums = _prefix_sums(block, powers)
                for prefix, members in by_prefix.items():
                    if prefix > len(block):
                        continue
                    starts = passing(_window_hashes(block, sums, scale, prefix)[:BLOCK_BYTES])
                    for length in members:
                        at = starts[starts + length <= len(block)]
                        spans = (sums[at + length] - sums[at]) * scale[at] + np.uint64(length)
                        at = at[passing(_mix(spans))] + start
                        # a window must lie within one document
                        owner = np.searchsorted(ends, at, side="right")
                        inside = at + length <= ends[owner]
                        found.update(
                            (int(d), stream[p : p + length]) for d, p in zip(owner[inside], at[inside])
                        )
            keys = batch[key].to_numpy()
            rows = [(keys[d], w) for d, raw in found if (w := _whole_text(raw)) is not None]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "needle"])

    return texts.select(key, F.lower(F.col(text)).alias(text)).mapInPandas(scan, out_schema)
