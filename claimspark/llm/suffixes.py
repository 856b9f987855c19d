"""Removal of repeated passages by prefix-free parsing.

A rolling hash over short grams triggers the parse: every string of the judged length has one trigger,
its gram of smallest hash, the leftmost of equals. Neighbouring strings with the same trigger make a
phrase, so phrases are chosen by content alone and each string lies whole in one phrase. The dictionary
is the set of different phrases, the parse says which texts hold them. Suffixes of the dictionary are
sorted (as deep as the judged length, which never reaches past a phrase), and ties are put in the order
of the parse's texts: that is the corpus order of all strings, read off without ever sorting the corpus.
The first text of each run of equal suffixes keeps the string.

Three passes over the texts, each without a shuffle of texts. The first finds triggers that occur in more
than one text; others cannot carry a repeat. The second sends the phrases of those triggers, each
different one once a slice, to be sorted. The third cuts. What is found lies as sorted arrays in the
shared folder, where the next pass looks it up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.arrays import in_buckets, look_up, mapped, packed, store, unpacked
from claimspark.llm.common import SLICE_BYTES, mix, powers, prefix_sums, slices, span_hash, table
from claimspark.session import fresh_path

LENGTH = 50                # bytes of a string
GRAM = 20                  # bytes of a trigger
SLICE_TEXT = 8 << 20       # text that one set of messages stands for, and text per bucket
LAST = (1 << 63) - 1       # the place of texts without an id


class Phrases(NamedTuple):
    """Phrases of some texts: strings ``first`` to ``last`` of text ``text`` share the trigger at ``gram``."""

    trigger: np.ndarray    # hash of the trigger, spread anew, as triggers have small hashes
    text: np.ndarray
    first: np.ndarray      # starts of strings, as bytes of the text
    last: np.ndarray
    gram: np.ndarray
    name: np.ndarray       # hash of the phrase and the place of its trigger


def parse(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Phrases:
    """The phrases of each text; texts shorter than ``length`` have none."""
    data = np.frombuffer(b"".join(texts) + bytes(length + gram), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    total, window = int(bounds[-1]), length - gram + 1
    sums = prefix_sums(data)
    n = len(data) - gram
    hashes = (sums[gram : gram + n] - sums[:n]) * powers(len(sums))[1][:n]
    least, span = hashes, 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - window + 1], least[window - span : n - span + 1])[:total]
    valid = np.ones(total, dtype=bool)
    for b in bounds[1:].tolist():
        valid[max(b - length + 1, 0) : b] = False
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < length:
            valid[a:b] = False
    # a trigger is new where the smallest hash changes, or where the old trigger has just been left behind
    new = np.ones(total, dtype=bool)
    if total:
        new[1:] = (least[1:] != least[:-1]) | (hashes[: total - 1] == least[:-1])
        new[1:] |= ~valid[:-1]
        new[bounds[:-1][bounds[:-1] < total]] = True
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.concatenate([(new | ~valid)[1:], [True]])) if total else first
    at = np.empty(len(first), dtype=np.int64)
    for i in range(0, len(first), 1 << 16):
        some = first[i : i + (1 << 16)]
        at[i : i + len(some)] = some + (hashes[some[:, None] + np.arange(window)] == least[some][:, None]).argmax(axis=1)
    text = np.searchsorted(bounds, first, "right") - 1
    name = span_hash(sums, first, stop + length) * np.uint64(2 * length + 1) + (at - first).astype(np.uint64)
    base = bounds[text]
    return Phrases(mix(hashes[at]), text, first - base, stop - base, at - base, name)


def suffix_order(phrases: np.ndarray, strings: np.ndarray, text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Strings of the dictionary in corpus order, and which of them begin a run of equal strings.

    ``phrases``: a row of bytes for each phrase; a string is ``strings[i] = (phrase, place)``, and
    ``text`` orders equal ones.
    """
    width = -(-length // 8) * 8
    view = np.lib.stride_tricks.sliding_window_view(phrases, width, axis=1)
    rows = view[strings[:, 0], strings[:, 1]].copy()
    rows[:, length:] = 0
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((text, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    ranked = words[order]
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    return order, begins


class Parse:
    """Where the arrays of a run lie, and how triggers and texts are dealt to buckets."""

    def __init__(self, uri: str, bits: int, width: int) -> None:
        self.uri, self.bits, self.width = uri, bits, width

    def bucket(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - self.bits)).astype(np.int64)

    def mark(self, trigger: np.ndarray) -> np.ndarray:
        """The leading bytes of a trigger's hash: enough to tell triggers apart nearly always; more only costs room."""
        return trigger >> np.uint64(64 - 8 * self.width)


def _messages(batches: Iterator[pa.RecordBatch], tell) -> Iterator[pa.RecordBatch]:
    """Run ``tell`` on slices of about ``SLICE_TEXT``; it gives pairs of a bucket and a message."""
    for batch in slices(batches, limit=SLICE_TEXT):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        key = batch.column("key").to_numpy().view(np.uint64)
        for bucket, body in tell(texts, key, batch.column("place").to_numpy()):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([body], pa.binary())], ["bucket", "body"])


def _parts(texts: list[bytes]) -> Iterator[tuple[int, Phrases]]:
    """Parse a slice some megabytes at a time; the first number of each part's texts comes along."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield start, parse(texts[start : i + 1])
            start, size = i + 1, 0


def _tell_triggers(run: Parse, texts: list[bytes], places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each different trigger of a slice, and whether several texts of it have it."""
    found = [(p.trigger, places[p.text + start]) for start, p in _parts(texts)]
    if not found:
        return
    trigger, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, trigger))
    trigger, place = trigger[order], place[order]
    new = np.ones(len(trigger), dtype=bool)
    new[1:] = trigger[1:] != trigger[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return
    several = np.maximum.reduceat(place, first) != place[first]
    marks = run.mark(trigger[first])
    cuts = np.searchsorted(run.bucket(trigger[first]), np.arange((1 << run.bits) + 1))
    for b in range(1 << run.bits):
        some = slice(*cuts[b : b + 2])
        if some.stop > some.start:
            gaps = np.diff(marks[some], prepend=np.uint64(0))
            planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : run.width].T)
            yield b, packed(planes, np.packbits(several[some]), np.array([some.stop - some.start]), np.array([place[first][some].min(), place[first][some].max()]))


def _merge_triggers(run: Parse, bucket: int, messages: list[bytes]) -> int:
    """Keep the triggers that more than one text has."""
    marks, several = [], []
    for m in messages:
        planes, bits, n, _ = unpacked(m, 4)
        wide = np.zeros((int(n[0]), 8), dtype=np.uint8)
        wide[:, : run.width] = planes.T
        marks.append(np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64))
        several.append(np.unpackbits(bits, count=int(n[0])).astype(bool))
    marks, several = np.concatenate(marks), np.concatenate(several)
    order = np.argsort(marks, kind="stable")
    marks, several = marks[order], several[order]
    again = np.zeros(len(marks), dtype=bool)
    again[1:] = marks[1:] == marks[:-1]
    shared = np.unique(marks[again | several])
    store(run.uri, f"trigger-keys-{bucket}", shared)
    return len(shared)


def _tell_phrases(run: Parse, texts: list[bytes], key: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The phrases whose trigger other texts have too, from the first text of the slice that has them.

    Later texts of the slice lose all strings of such a phrase; that goes straight to their own bucket (below -1).
    """
    kept = []
    for start, p in _parts(texts):
        there = np.zeros(len(p.trigger), dtype=bool)
        for b, at in in_buckets(run.bucket(p.trigger)):
            there[at] = look_up(run.uri, b, "trigger", run.mark(p.trigger[at]))[0] >= 0
        kept.append(Phrases(p.trigger[there], p.text[there] + start, *(x[there] for x in p[2:])))
    if not kept:
        return
    p = Phrases(*(np.concatenate(x) for x in zip(*kept)))
    if not len(p.text):
        return
    place = places[p.text]
    order = np.lexsort((place, p.name))
    new = np.ones(len(order), dtype=bool)
    new[1:] = p.name[order][1:] != p.name[order][:-1]
    earliest = np.empty(len(order), dtype=np.int64)
    earliest[order] = place[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = place > earliest
    yield from _tell_spans(run, key[p.text[later]], p.first[later], p.last[later] + LENGTH)
    own = np.flatnonzero(~later)
    for b, at in in_buckets(run.bucket(p.trigger[own])):
        at = own[at]
        pieces = b"".join(texts[t][a:e] for t, a, e in zip(p.text[at].tolist(), p.first[at].tolist(), (p.last[at] + LENGTH).tolist()))
        yield b, packed(
            np.frombuffer(pieces, dtype=np.uint8), p.first[at].astype(np.uint32), (p.last[at] - p.first[at]).astype(np.uint8),
            (p.gram[at] - p.first[at]).astype(np.uint8), key[p.text[at]], place[at],
        )


def _tell_spans(run: Parse, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Spans to remove, for the buckets of their texts; those of one text that touch go as one."""
    key, start, end = _united(key, start, end)
    for b, at in in_buckets(run.bucket(key)):
        yield -2 - b, packed(key[at], start[at].astype(np.uint32), end[at].astype(np.uint32))


def _united(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted spans, those of one text that overlap or touch made one."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    # running maximum of the ends within a text: lift each text above the ones before it
    text = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    lift = text * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (start + lift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(key) - 1]])
    return key[first], start[first], reach[last] - lift[last]


def _merge_phrases(run: Parse, messages: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Sort the suffixes of a bucket's dictionary and tell which spans the parse loses."""
    pieces, first, more, gram, key, place = (np.concatenate(x) for x in zip(*(unpacked(m, 6) for m in messages)))
    size = more.astype(np.int64) + LENGTH
    widest = 2 * LENGTH - GRAM + 1 + 8
    rows = np.zeros((len(first), -(-widest // 8) * 8), dtype=np.uint8)
    rows[np.arange(rows.shape[1]) < size[:, None]] = pieces
    # the dictionary: different phrases, each with the first text that has it
    words = np.concatenate([rows, more[:, None], gram[:, None], np.zeros((len(rows), 6), dtype=np.uint8)], axis=1).view(np.uint64)
    order = np.lexsort((place, *words.T))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    phrase = np.empty(len(order), dtype=np.int64)
    phrase[order] = np.cumsum(new) - 1
    head = order[new]
    owner = place[head]
    later = place > owner[phrase]
    spans = [(key[later], first[later].astype(np.int64), first[later] + size[later])]
    count = more[head].astype(np.int64) + 1
    entry = np.repeat(np.arange(len(head)), count)
    offset = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    lost = np.zeros(len(entry), dtype=bool)
    for part in _stretches(entry, gram[head]):
        ranks, begins = suffix_order(rows[head], np.stack([entry[part], offset[part]], axis=1), owner[entry[part]])
        ranked = owner[entry[part]][ranks]
        lost[part[ranks]] = ranked > ranked[np.maximum.accumulate(np.where(begins, np.arange(len(ranks)), 0))]
    # the lost strings of each phrase, for all of its places in its first texts
    where = np.flatnonzero(~later)
    starts = np.cumsum(count) - count
    times = count[phrase[where]]
    string = np.repeat(starts[phrase[where]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    gone = lost[string]
    whose, at = np.repeat(where, times)[gone], first[np.repeat(where, times)[gone]] + offset[string[gone]]
    spans.append((key[whose], at, at + LENGTH))
    yield from _tell_spans(run, *(np.concatenate(x) for x in zip(*spans)))


def _stretches(entry: np.ndarray, gram: np.ndarray) -> list[np.ndarray]:
    """Sets of strings that are sorted apart: equal strings have their trigger at the same place."""
    _, offset = np.unique(entry, return_index=True)
    place = gram[entry].astype(np.int64) - (np.arange(len(entry)) - np.repeat(offset, np.diff([*offset, len(entry)])))
    return [at for _, at in in_buckets(place)]


def _merge_spans(run: Parse, bucket: int, messages: list[bytes]) -> int:
    key, start, end = _united(*(np.concatenate(x) for x in zip(*(unpacked(m, 3) for m in messages))))
    own, first = np.unique(key, return_index=True)
    store(run.uri, f"text-keys-{bucket}", own)
    store(run.uri, f"text-values-{bucket}", np.stack([first, np.append(first[1:], len(key))], axis=1) if len(own) else np.zeros((0, 2), np.int64))
    store(run.uri, f"spans-{bucket}", np.stack([start, end], axis=1))
    return len(own)


def find_repeats(docs: DataFrame) -> Parse:
    """Find the repeats of ``key, place, text`` rows, and leave them as arrays in the shared folder.

    ``key`` (long) identifies a text, ``place`` (long) orders texts.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(2, (max(size, 1) // SLICE_TEXT).bit_length())
    run = Parse(fresh_path(docs.sparkSession, "repeats"), bits, min(8, max(5, -(-(max(size, 1).bit_length() + 10) // 8))))
    schema = "bucket bigint, body binary"

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _messages(batches, lambda texts, key, place: _tell_triggers(run, texts, place))

    def keep_triggers(group: pa.Table) -> pa.Table:
        return pa.table({"n": [_merge_triggers(run, group["bucket"][0].as_py(), group["body"].to_pylist())]})

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _messages(batches, lambda texts, key, place: _tell_phrases(run, texts, key, place))

    def sort_phrases(group: pa.Table) -> pa.Table:
        bucket, bodies = group["bucket"][0].as_py(), group["body"].to_pylist()
        told = [(bucket, b) for b in bodies] if bucket < 0 else list(_merge_phrases(run, bodies))
        return pa.table({"bucket": pa.array([-2 - b for b, _ in told], pa.int64()), "body": pa.array([m for _, m in told], pa.binary())})

    def keep_spans(group: pa.Table) -> pa.Table:
        return pa.table({"n": [_merge_spans(run, group["bucket"][0].as_py(), group["body"].to_pylist())]})

    total = F.coalesce(F.sum("n"), F.lit(0))
    docs.mapInArrow(triggers, schema).groupBy("bucket").applyInArrow(keep_triggers, "n bigint").agg(total).first()
    sorted_ = docs.mapInArrow(phrases, schema).groupBy("bucket").applyInArrow(sort_phrases, schema)
    sorted_.groupBy("bucket").applyInArrow(keep_spans, "n bigint").agg(total).first()
    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans, kept`` of every row: the removed byte spans (``start``, ``end``), and what is left.

    Each byte goes that is covered by a string of ``LENGTH`` bytes that also starts in a text with a smaller id.
    ``spans`` are the longest removed runs; ``kept`` is binary, as a cut may fall inside a character. NULL text is
    empty. Texts without an id come after all others. Texts of one id do not take from each other. Repeated rows
    lose the same. Short texts lose nothing, an empty table gives no rows, other columns are not read.
    """
    read = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("place"),
        F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(text).alias("text"),
    )
    run = find_repeats(read.select("key", "place", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 * SLICE_BYTES):
            keys = batch.column("key").to_numpy().view(np.uint64)
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            spans: list[list] = [[] for _ in texts]
            for b, at in in_buckets(run.bucket(keys)):
                found, values = look_up(run.uri, b, "text", keys[at])
                for i, f in zip(at.tolist(), found.tolist()):
                    if f >= 0:
                        spans[i] = mapped(run.uri, f"spans-{b}")[slice(*values[f])].tolist()
            kept = []
            for t, some in zip(texts, spans):
                edges = [0, *(x for s in some for x in s), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])) if some else t)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind), pa.array(kept, pa.binary())],
                ["doc_id", "spans", "kept"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return read.select("doc_id", "key", "text").mapInArrow(cut, f"doc_id {kind}, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op4_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), k AS (
  SELECT r, doc_id, h, unnest(range(0, len(h) // 2, 512)) AS k FROM d
), q AS (
  SELECT r, doc_id, k, substr(h, 2 * k + 1, 2 * {511 + LENGTH}) AS h FROM k
), p AS (
  SELECT *, unnest(range(0, least(512, len(h) // 2))) AS j FROM q
), s AS (
  SELECT r, doc_id, k + j AS i, substr(h, 2 * j + 1, 2) AS b,
         CASE WHEN 2 * (j + {LENGTH}) <= len(h) THEN substr(h, 2 * j + 1, {2 * LENGTH}) END AS s
  FROM p
), f AS (
  SELECT s, min(coalesce(doc_id, {LAST})) AS first_id FROM s WHERE s IS NOT NULL GROUP BY s
), c AS (
  SELECT r, i, b, coalesce(max(first_id < coalesce(doc_id, {LAST})) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), false) AS gone
  FROM s LEFT JOIN f USING (s)
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM c
), a AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
         string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM e GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
