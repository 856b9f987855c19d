"""Benchmark decontamination as a prefix-filtered set join.

An item is cut in windows of a fixed number of words (one window if it is shorter). The set of a
window is its shingles, ordered by rarity in the whole corpus. For a window to be contained, all its
shingles must occur, so one prefix token, the rarest shingle, is enough to find every candidate. The
place of the shingle in the window and the length of the text bound where the window can stand;
there it is verified word by word.

Items travel to the texts in blocks of bounded size, the texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import ALNUM, ngram_hashes, slices, table, words_of
from claimspark.session import materialise

WINDOW = 10            # words
SHINGLE = 3            # words of a token of the join
BLOCK_BYTES = 32 << 20     # of item text sent to the workers at once


class Windows:
    """The windows of a block of items, each different one once, with the items that hold it.

    ``words`` has a row of word hashes for each window, ``length`` its number of words.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], window: int, shingle: int) -> None:
        found: dict[bytes, list] = {}
        self.window, self.shingle = window, shingle
        w = words_of([text for _, text in items], ALNUM)
        for (item, _), a, b in zip(items, w.offsets[:-1], w.offsets[1:]):
            size = min(window, b - a)
            for s in range(a, b - size + 1) if size else ():
                named = found.setdefault(w.hashes[s : s + size].tobytes(), [])
                if item is not None:       # an item without an id hits, but has no name to give
                    named.append(item)
        keys = list(found)
        self.items = [sorted(set(found[k])) for k in keys]
        self.length = np.array([len(k) // 8 for k in keys], dtype=np.int64)
        self.words = np.zeros((len(keys), window), dtype=np.uint64)
        for i, k in enumerate(keys):
            self.words[i, : self.length[i]] = np.frombuffer(k, dtype=np.uint64)
        # every shingle of every window: its hash and its place; shorter windows are one shingle
        tokens, owner, place = [], [], []
        for i, n in enumerate(self.length):
            h = ngram_hashes(self.words[i, :n], min(shingle, n))
            tokens.append(h)
            owner += [i] * len(h)
            place += range(len(h))
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
        self.owner, self.place = np.array(owner, dtype=np.int64), np.array(place, dtype=np.int64)
        self.vocabulary = np.unique(self.tokens)
        self.sizes = sorted({min(shingle, int(n)) for n in self.length})

    def order_by(self, counts: dict[int, int]) -> None:
        """Keep one prefix token for each window: the rarest shingle, the first of equally rare ones."""
        rarity = np.array([counts.get(int(t), 0) for t in self.tokens.view(np.int64)], dtype=np.int64)
        order = np.lexsort((self.place, rarity, self.owner))
        first = np.ones(len(order), dtype=bool)
        first[1:] = self.owner[order][1:] != self.owner[order][:-1]
        keep = order[first]
        keep = keep[np.argsort(self.tokens[keep], kind="stable")]
        self.tokens, self.owner, self.place = self.tokens[keep], self.owner[keep], self.place[keep]

    def present(self, hashes: np.ndarray, sought: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and hashes of the shingles, of each size in use, that are among the sorted ``sought``."""
        for n in self.sizes:
            h = ngram_hashes(hashes, n)
            at = np.minimum(np.searchsorted(sought, h), len(sought) - 1)
            starts = np.flatnonzero(sought[at] == h)
            yield starts, h[starts]

    def occurrences(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of windows in texts laid end to end: first word, and window."""
        starts, windows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        ends = offsets[1:]
        for at, found in self.present(hashes, np.unique(self.tokens)):
            low = np.searchsorted(self.tokens, found, "left")
            times = np.searchsorted(self.tokens, found, "right") - low
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            owner = self.owner[which]
            seen = np.repeat(at, times)
            first = seen - self.place[which]
            # position and length bounds: the window begins and ends in the text of its token
            text = np.searchsorted(ends, seen, "right")
            fits = (first >= offsets[text]) & (first + self.length[owner] <= ends[text])
            first, owner = first[fits], owner[fits]
            same = np.ones(len(first), dtype=bool)
            for k in range(self.window):
                inside = same & (k < self.length[owner])
                same[inside] = hashes[first[inside] + k] == self.words[owner[inside], k]
            starts.append(first[same])
            windows.append(owner[same])
        return np.concatenate(starts), np.concatenate(windows)


def _block_counts(docs: DataFrame, windows: Windows) -> dict[int, int]:
    """How often each shingle of the block occurs in the whole corpus (at most its vocabulary comes back)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(windows.vocabulary), dtype=np.int64)
        for batch in slices(batches):
            w = words_of(batch.column("text").cast(pa.binary()).to_pylist(), ALNUM)
            for _, found in windows.present(w.hashes, windows.vocabulary):
                total += np.bincount(np.searchsorted(windows.vocabulary, found), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(windows.vocabulary[some].view(np.int64)), pa.array(total[some])], ["token", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def _mark(docs: DataFrame, windows: Windows, item_type: str, keep: list[str]) -> DataFrame:
    """Add what the windows of one block hit to ``hits`` (first and last word) and ``items``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words_of(batch.column("text").cast(pa.binary()).to_pylist(), ALNUM)
            starts, which = windows.occurrences(w.hashes, w.offsets)
            text = np.searchsorted(w.offsets[1:], starts, "right")
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for t, s, v in zip(text.tolist(), (starts - w.offsets[text]).tolist(), which.tolist()):
                hits[t].append({"first": s, "last": s + int(windows.length[v]) - 1})
                items[t].extend(windows.items[v])
            n = pa.array(np.diff(w.offsets).astype(np.int64))
            spans = pa.array([_joined(h) for h in hits], batch.schema.field("hits").type)
            named = pa.array([sorted(set(i)) for i in items], batch.schema.field("items").type)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), n, spans, named], [*keep, "n_words", "hits", "items"]
            )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in keep)
    out = f"{kept}n_words bigint, hits array<struct<first: bigint, last: bigint>>, items array<{item_type}>"
    return docs.select(*dict.fromkeys([*keep, "text", "hits", "items"])).mapInArrow(scan, out)


def _joined(spans: list[dict]) -> list[dict]:
    """Unite spans that overlap or touch."""
    merged: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if merged and s["first"] <= merged[-1]["last"] + 1:
            merged[-1]["last"] = max(merged[-1]["last"], s["last"])
        else:
            merged.append(dict(s))
    return merged


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str] | None = None,
    item: str = "item_id",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row of ``docs``, and ``n_words, hits, items``.

    ``hits``: disjoint spans of words (``first`` to ``last``, from 0) covered by windows of items;
    ``items``: sorted ids of the items with a window in the text. NULL and empty texts have no words and
    no hits; items without words have no windows; repeated rows are judged each; equal items are all
    named; an item with a NULL id hits like any other, but is left out of ``items``. Without items nothing is hit. Columns of ``docs`` with the
    names of the new ones are replaced. Benchmarks larger than ``block_bytes`` are worked through in blocks.
    """
    some = items.select(F.col(item).alias("item"), F.col("text")).where("text is not null")
    size = some.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (block_bytes // 2)))
    stored = some if blocks == 1 else materialise(some, "benchmark")
    item_type = items.schema[item].dataType.simpleString()
    marked = docs.withColumns({
        "hits": F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)"),
        "items": F.expr(f"cast(array() as array<{item_type}>)"),
    })
    keep = [c for c in (keep or docs.columns) if c not in ("n_words", "hits", "items")]
    for b in range(blocks):
        part = stored if blocks == 1 else stored.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        windows = Windows([(r["item"], r["text"].encode()) for r in part.collect()], window, shingle)
        if len(windows.vocabulary):
            windows.order_by(_block_counts(docs, windows))
        through = keep if b == blocks - 1 else list(dict.fromkeys([*keep, "text"]))
        marked = _mark(marked, windows, item_type, through)
    return marked


def op8_prefix_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["last"] - h["first"] + 1)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), v AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 8)::BIGINT), lambda k: array_to_string(w[k : k + least(10, len(w)) - 1], ' '))) AS win
  FROM i WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM v
), g AS (
  SELECT r, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS k, w FROM d, sizes WHERE len(w) >= n
), m AS (
  SELECT DISTINCT r, k, v.n, item_id FROM (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM g) g JOIN v ON v.n = g.n AND v.win = g.win
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
