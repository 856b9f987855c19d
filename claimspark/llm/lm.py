"""Scoring texts by an interpolated modified Kneser-Ney model of word pairs or triples.

Counting: a slice of texts becomes one message for each bucket of context words, with its distinct pairs
and their counts. A bucket's task adds the messages up and writes sorted hash arrays to the shared folder:
the pairs with their counts, the contexts with their totals. What a word's distinct contexts number to is
added up by word in a second round. Scoring: workers map the arrays into memory and look up what the texts
hold; nothing is shuffled, and the arrays' pages are shared by all workers of a machine.

Very frequent contexts are dealt by their second word, so no bucket grows with them. Which ones
these are is guessed from a sample; the guess changes where pairs are counted, not the counts.

With order three, triples are counted first, by the same slices and buckets of their two context words. A pair's
count is then that of its different words before, so each bucket of triples tells the buckets of pairs how many
it has, as a slice of texts does with order two. A text begins with two beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.arrays import in_buckets, look_up, packed, store, unpacked
from claimspark.llm.common import CRC_TABLE, SLICE_BYTES, crc32_sql, drawn, fold_of, mix, slices, table, words_of
from claimspark.session import fresh_path

SLICE_TEXT = 8 << 20       # text that one set of messages stands for, and text per bucket
HEAVY_DOCS, HEAVY_CHARS, HEAVY_WORDS = 1000, 4096, 256     # the sample for frequent contexts
WORD_BITS = 40             # of a second word inside its pair
LEAST_DISCOUNT = 0.01

BEGIN, END = (int(mix(np.array([k], dtype=np.uint64))[0]) for k in (1, 2))
_PAIR = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- texts as tokens

class Tokens:
    """Tokens of some texts laid end to end: their words, then an end for each text.

    ``words`` holds the different ones, sorted, ``token`` and ``context`` point into it. Text i starts
    at ``first[i]``; the context of its first token is the beginning.
    """

    def __init__(self, texts: list[bytes | None]) -> None:
        hashes, counts, held, size = [], [], [], 0
        for text in [*texts, None]:
            if held and (size > SLICE_BYTES or text is None and len(counts) + len(held) == len(texts)):
                w = words_of(held)
                hashes.append(w.hashes)
                counts.extend(np.diff(w.offsets).tolist())
                held, size = [], 0
            held.append(text)
            size += len(text or b"")
        self.n = np.array(counts, dtype=np.int64) + 1
        ends = np.cumsum(self.n) - 1
        self.first = ends + 1 - self.n
        tokens = np.full(int(self.n.sum()), END, dtype=np.uint64)
        inside = np.ones(len(tokens), dtype=bool)
        inside[ends] = False
        tokens[inside] = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.words, place = np.unique(np.concatenate([tokens, np.array([BEGIN], dtype=np.uint64)]), return_inverse=True)
        self.token, begin = place[:-1].astype(np.int64), int(place[-1])
        self.context = np.concatenate([[begin], self.token[:-1]])
        self.context[self.first] = begin

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different contexts of two places, the different triples as context and word, how often each occurs, and the triple of each token."""
        before = np.concatenate([self.context[:1], self.context[:-1]])
        before[self.first] = self.context[self.first]
        both, context = np.unique(before * len(self.words) + self.context, return_inverse=True)
        keys, of_token, n = np.unique(context * len(self.words) + self.token, return_inverse=True, return_counts=True)
        return both // len(self.words), both % len(self.words), keys // len(self.words), keys % len(self.words), n, of_token

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs as places of context and word, how often each occurs, and the pair of each token."""
        keys, of_token, n = np.unique(self.context * len(self.words) + self.token, return_inverse=True, return_counts=True)
        return keys // len(self.words), keys % len(self.words), n, of_token


def short(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - WORD_BITS)


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * _PAIR + word)


def as_five(values: np.ndarray) -> np.ndarray:
    """40-bit values as rows of five bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def from_five(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, :5] = rows
    return wide.view("<u8").ravel().astype(np.uint64)


# ---------------------------------------------------------------- the model

def discounts(n: list[int]) -> list[float]:
    """For counts of 1, 2, and 3 or more, from how many types occur 1, 2, 3, 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    found = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[0] and n[k - 1] else k / 2
        found.append(min(max(d, LEAST_DISCOUNT), float(k)))
    return found


class Model:
    """Where the arrays lie, and the figures of the whole corpus."""

    def __init__(self, uri: str, bits: int, heavy: np.ndarray, heavy_pairs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.uri, self.bits, self.heavy = uri, bits, heavy
        #: With order three, the hashes of frequent pairs as contexts, sorted, and their second words.
        self.heavy_pairs = heavy_pairs
        self.triple_counts = [0] * 4
        self.heavy_pair_sums = np.zeros((len(heavy_pairs[0]) if heavy_pairs else 0, 4), dtype=np.int64)
        self.tokens = self.types = self.pair_types = 0
        self.pair_counts, self.word_counts, self.word_classes = [0] * 4, [0] * 4, [0] * 3
        self.heavy_sums = np.zeros((len(heavy), 4), dtype=np.int64)

    def bucket(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - self.bits)).astype(np.int64)

    def bucket_of_short(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(WORD_BITS - self.bits)).astype(np.int64)

    def heavy_place(self, words: np.ndarray) -> np.ndarray:
        return _place(self.heavy, words)

    def contexts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's count; and as a context its total, and its successors that occur once, twice, more often."""
        count, sums = np.zeros(len(words), dtype=np.int64), np.zeros((len(words), 4), dtype=np.int64)
        for b, at in in_buckets(self.bucket(words)):
            found, values = look_up(self.uri, b, "context", words[at])
            there = found >= 0
            if there.any():
                rows = np.asarray(values[found[there]])
                count[at[there]], sums[at[there]] = rows[:, 0], rows[:, 1:]
        place = self.heavy_place(words)
        sums[place >= 0] = self.heavy_sums[place[place >= 0]]
        return count, sums

    def unigrams(self, words: np.ndarray) -> np.ndarray:
        """Probability of each word by its number of different contexts."""
        after = np.zeros(len(words), dtype=np.int64)
        small = short(words)
        for b, at in in_buckets(self.bucket_of_short(small)):
            found, values = look_up(self.uri, b, "word", small[at])
            there = found >= 0
            if there.any():
                after[at[there]] = values[found[there]]
        if not self.pair_types:
            return np.full(len(words), 1.0 / (self.types + 1))
        d = np.array(discounts(self.word_counts))
        left = float(np.dot(d[1:], self.word_classes)) / self.pair_types / (self.types + 1)
        return np.maximum(after - d[np.minimum(after, 3)], 0) / self.pair_types + left

    def pair_count(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often each pair occurs in the training texts."""
        n, small = np.zeros(len(context), dtype=np.int64), short(word)
        bucket = np.where(self.heavy_place(context) >= 0, self.bucket_of_short(small), self.bucket(context))
        hashes = pair_hash(context, small)
        for b, at in in_buckets(bucket):
            found, values = look_up(self.uri, b, "pair", hashes[at])
            there = found >= 0
            if there.any():
                n[at[there]] = values[found[there]]
        return n

    def triple_logs(self, t: Tokens, lower: np.ndarray) -> np.ndarray:
        """Logarithm of each token's probability after two words; ``lower`` is that after one."""
        u, v, context, word, _, of_token = t.triples()
        hashes, small = pair_hash(t.words[u], t.words[v]), short(t.words[word])
        sums = np.zeros((len(hashes), 4), dtype=np.int64)
        for b, at in in_buckets(self.bucket(hashes)):
            found, values = look_up(self.uri, b, "couple", hashes[at])
            there = found >= 0
            if there.any():
                sums[at[there]] = values[found[there]]
        place = _place(self.heavy_pairs[0], hashes)
        sums[place >= 0] = self.heavy_pair_sums[place[place >= 0]]
        n, keys = np.zeros(len(word), dtype=np.int64), pair_hash(hashes[context], small)
        for b, at in in_buckets(np.where(place[context] >= 0, self.bucket_of_short(small), self.bucket(hashes)[context])):
            found, values = look_up(self.uri, b, "triple", keys[at])
            there = found >= 0
            if there.any():
                n[at[there]] = values[found[there]]
        d, total = np.array(discounts(self.triple_counts)), np.maximum(sums[:, 0], 1)
        weight = np.where(sums[:, 0] > 0, sums[:, 1:] @ d[1:] / total, 1.0)
        own = np.maximum(n - d[np.minimum(n, 3)], 0) / total[context]
        after = np.zeros(len(word))
        after[of_token] = lower
        return np.log10(own + weight[context] * after)[of_token]

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        """``n_tokens, n_known, base_score, score`` of each text; logarithms to base 10."""
        t = Tokens(texts)
        count, sums = self.contexts(t.words)
        lower = self.unigrams(t.words)
        context, word, _, of_token = t.pairs()
        n, d = self.pair_count(t.words[context], t.words[word]), np.array(discounts(self.pair_counts))
        total = np.maximum(sums[:, 0], 1)
        weight = np.where(sums[:, 0] > 0, sums[:, 1:] @ d[1:] / total, 1.0)
        own = np.maximum(n - d[np.minimum(n, 3)], 0) / total[context]
        after_one = (own + weight[context] * lower[word])[of_token]
        logs = self.triple_logs(t, after_one) if self.heavy_pairs else np.log10(after_one)
        base = np.log10((count + 1) / (self.tokens + 1 * (self.types + 1)))
        if not len(t.n):
            return {k: np.zeros(0) for k in ("n_tokens", "n_known", "base_score", "score")}
        return {
            "n_tokens": t.n,
            "n_known": np.add.reduceat((count > 0).astype(np.int64)[t.token], t.first),
            "base_score": np.add.reduceat(base[t.token], t.first),
            "score": np.add.reduceat(logs, t.first),
        }


def _place(heavy: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Places in the sorted, never empty ``heavy``; -1 where it is not there."""
    at = np.minimum(np.searchsorted(heavy, sought), len(heavy) - 1)
    return np.where(heavy[at] == sought, at, -1)


def _triple_messages(model: Model, texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
    """What a slice of training texts tells each bucket of triples, and each bucket of words how often they occur."""
    t = Tokens(texts)
    u, v, context, word, n, _ = t.triples()
    hashes, small = pair_hash(t.words[u], t.words[v]), short(t.words)
    place = _place(model.heavy_pairs[0], hashes)
    special = place[context] >= 0
    count = np.bincount(t.token, minlength=len(t.words)).astype(np.uint32)
    # light triples in the order of their contexts' hashes, which is that of the buckets
    own = np.flatnonzero(place < 0)
    own = own[np.argsort(hashes[own], kind="stable")]
    rank = np.full(len(hashes), len(own))
    rank[own] = np.arange(len(own))
    light = np.flatnonzero(~special)
    light = light[np.argsort(rank[context[light]], kind="stable")]
    fan = np.bincount(rank[context[light]], minlength=len(own)).astype(np.uint32)
    edges = np.arange((1 << model.bits) + 1)
    cuts, word_cuts = np.searchsorted(model.bucket(hashes[own]), edges), np.searchsorted(model.bucket(t.words), edges)
    triple_cuts = np.concatenate([[0], np.cumsum(fan, dtype=np.int64)])[cuts]
    special = np.flatnonzero(special)
    dealt = dict(in_buckets(model.bucket_of_short(small[word[special]])))
    for b in range(1 << model.bits):
        c, p, w = (slice(*x[b : b + 2]) for x in (cuts, triple_cuts, word_cuts))
        at = special[dealt.get(b, np.zeros(0, dtype=np.int64))]
        if c.stop > c.start or w.stop > w.start or len(at):
            yield b, packed(
                hashes[own[c]], t.words[v[own[c]]], fan[c], as_five(small[word[light[p]]]), n[light[p]].astype(np.uint32),
                place[context[at]].astype(np.uint16), as_five(small[word[at]]), n[at].astype(np.uint32), t.words[w], count[w],
            )


def _merge_triples(model: Model, bucket: int, messages: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Add up a bucket's triples and write its arrays; tells the buckets of pairs what slices of texts tell with order two, and -2 the figures."""
    parts = list(zip(*(unpacked(m, 10) for m in messages)))
    couples, seconds, fan, light_words, light_n, heavy, heavy_words, heavy_n, words, count = (np.concatenate(p) for p in parts)
    context = np.concatenate([np.repeat(couples, fan), model.heavy_pairs[0][heavy]])
    second = np.concatenate([np.repeat(seconds, fan), model.heavy_pairs[1][heavy]])
    word = np.concatenate([from_five(light_words), from_five(heavy_words)])
    keys, n, context, second, word = _summed(
        pair_hash(context, word), np.concatenate([light_n, heavy_n]).astype(np.int64), context, second, word
    )
    store(model.uri, f"triple-keys-{bucket}", keys)
    store(model.uri, f"triple-values-{bucket}", n if n.max(initial=0) >= 1 << 32 else n.astype(np.uint32))
    own, place = np.unique(couples), _place(model.heavy_pairs[0], context)
    rows, heavy_rows = np.zeros((len(own), 4), dtype=np.int64), np.zeros((len(model.heavy_pairs[0]), 4), dtype=np.int64)
    for target, at, rest in ((rows, np.searchsorted(own, context), place < 0), (heavy_rows, place, place >= 0)):
        np.add.at(target[:, 0], at[rest], n[rest])
        for k in (1, 2, 3):
            which = rest & (np.minimum(n, 3) == k)
            np.add.at(target[:, k], at[which], 1)
    store(model.uri, f"couple-keys-{bucket}", own)
    store(model.uri, f"couple-values-{bucket}", rows if rows.max(initial=0) >= 1 << 32 else rows.astype(np.uint32))
    yield -2, packed(np.array([int((n == k).sum()) for k in (1, 2, 3, 4)], dtype=np.int64), heavy_rows)
    _, n, second, word = _summed(pair_hash(second, word), np.ones(len(word), dtype=np.int64), second, word)
    place = model.heavy_place(second)
    light = np.flatnonzero(place < 0)
    light = light[np.argsort(second[light], kind="stable")]
    contexts, fan = np.unique(second[light], return_counts=True)
    words, count = _summed(words, count.astype(np.int64))
    edges = np.arange((1 << model.bits) + 1)
    cuts, word_cuts = np.searchsorted(model.bucket(contexts), edges), np.searchsorted(model.bucket(words), edges)
    pair_cuts = np.concatenate([[0], np.cumsum(fan, dtype=np.int64)])[cuts]
    special = np.flatnonzero(place >= 0)
    dealt = dict(in_buckets(model.bucket_of_short(word[special])))
    for b in range(1 << model.bits):
        c, p, w = (slice(*x[b : b + 2]) for x in (cuts, pair_cuts, word_cuts))
        at = special[dealt.get(b, np.zeros(0, dtype=np.int64))]
        if c.stop > c.start or w.stop > w.start or len(at):
            told, none = contexts[c], np.zeros(w.stop - w.start, dtype=np.uint32)
            yield b, packed(
                np.concatenate([told, words[w]]), np.concatenate([np.zeros(len(told), dtype=np.int64), count[w]]),
                np.concatenate([fan[c].astype(np.uint32), none]), as_five(word[light[p]]), n[light[p]].astype(np.uint32),
                place[at].astype(np.uint16), as_five(word[at]), n[at].astype(np.uint32),
            )


def _messages(model: Model, texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
    """What a slice of training texts tells each bucket."""
    t = Tokens(texts)
    context, word, n, _ = t.pairs()
    words, small = t.words, short(t.words)
    place = model.heavy_place(words)
    special = place[context] >= 0
    light = ~special
    fan = np.bincount(context[light], minlength=len(words)).astype(np.uint32)
    count = np.bincount(t.token, minlength=len(words)).astype(np.uint32)
    context_cuts = np.searchsorted(model.bucket(words), np.arange((1 << model.bits) + 1))
    pair_cuts = np.concatenate([[0], np.cumsum(fan, dtype=np.int64)])[context_cuts]
    pair_words, pair_n = small[word[light]], n[light].astype(np.uint32)
    own = dict(in_buckets(model.bucket_of_short(small[word[special]])))
    heavy, heavy_words, heavy_n = place[context[special]].astype(np.uint16), small[word[special]], n[special].astype(np.uint32)
    for b in range(1 << model.bits):
        c, p = slice(*context_cuts[b : b + 2]), slice(*pair_cuts[b : b + 2])
        at = own.get(b, np.zeros(0, dtype=np.int64))
        if c.stop > c.start or len(at):
            yield b, packed(
                words[c], count[c], fan[c], as_five(pair_words[p]), pair_n[p], heavy[at], as_five(heavy_words[at]), heavy_n[at]
            )


def _summed(keys: np.ndarray, values: np.ndarray, *beside: np.ndarray) -> list[np.ndarray]:
    """Different keys in order, the sum of their values, and what stands beside the first of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(values[order], first) if len(keys) else values
    return [keys[first], sums, *(x[order][first] for x in beside)]


def _merge_pairs(model: Model, bucket: int, messages: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Add up a bucket's messages and write its arrays; tells each word's bucket about contexts, and -1 the figures."""
    parts = list(zip(*(unpacked(m, 8) for m in messages)))
    words, count, fan, pair_words, pair_n, heavy, heavy_words, heavy_n = (np.concatenate(p) for p in parts)
    context = np.concatenate([np.repeat(words, fan), model.heavy[heavy]])
    word = np.concatenate([from_five(pair_words), from_five(heavy_words)])
    keys, n, context, word = _summed(
        pair_hash(context, word), np.concatenate([pair_n, heavy_n]).astype(np.int64), context, word
    )
    store(model.uri, f"pair-keys-{bucket}", keys)
    store(model.uri, f"pair-values-{bucket}", n if n.max(initial=0) >= 1 << 32 else n.astype(np.uint32))
    own, count = _summed(words, count.astype(np.int64))
    rows = np.zeros((len(own), 5), dtype=np.int64)
    rows[:, 0] = count
    place = model.heavy_place(context)
    heavy_rows = np.zeros((len(model.heavy), 4), dtype=np.int64)
    for target, at, rest in ((rows[:, 1:], np.searchsorted(own, context), place < 0), (heavy_rows, place, place >= 0)):
        np.add.at(target[:, 0], at[rest], n[rest])
        for k in (1, 2, 3):
            which = rest & (np.minimum(n, 3) == k)
            np.add.at(target[:, k], at[which], 1)
    store(model.uri, f"context-keys-{bucket}", own)
    store(model.uri, f"context-values-{bucket}", rows)
    times = [int((n == k).sum()) for k in (1, 2, 3, 4)]
    yield -1, packed(np.array([*times, int(count.sum()), int((count > 0).sum()), len(n)], dtype=np.int64), heavy_rows)
    word, contexts = np.unique(word, return_counts=True)
    for b, at in in_buckets(model.bucket_of_short(word)):
        yield b, packed(as_five(word[at]), contexts[at].astype(np.uint32))


def _merge_words(model: Model, bucket: int, messages: list[bytes]) -> bytes:
    """Add up what a bucket of words was told, or the figures of all buckets."""
    first, second = (np.concatenate([p[None] if bucket < 0 else p for p in x]) for x in zip(*(unpacked(m, 2) for m in messages)))
    if bucket < 0:
        return packed(first.sum(axis=0), second.sum(axis=0))
    words, n = _summed(from_five(first), second.astype(np.int64))
    store(model.uri, f"word-keys-{bucket}", words)
    store(model.uri, f"word-values-{bucket}", n.astype(np.uint32))
    return packed(np.array([int((n == k).sum()) for k in (1, 2, 3, 4)]), np.array([int((n == 1).sum()), int((n == 2).sum()), int((n > 2).sum())]))


def _heavy_pairs(t: Tokens, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are frequent contexts in the sample, and that of two beginnings."""
    u, v, context, _, n, _ = t.triples()
    seen = np.bincount(context, weights=n, minlength=len(u))
    frequent = np.argsort(-seen, kind="stable")[: HEAVY_WORDS - 1]
    frequent = frequent[(seen[frequent] > len(t.token) / (1 << bits) / 8) & (seen[frequent] > 1)]
    begin = np.array([BEGIN], dtype=np.uint64)
    first, second = np.concatenate([t.words[u[frequent]], begin]), np.concatenate([t.words[v[frequent]], begin])
    hashes, at = np.unique(pair_hash(first, second), return_index=True)
    return hashes, second[at]


def train(texts: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count the pairs, with ``order`` 3 the triples, of all ``texts`` and write the model to the shared folder. NULL texts are empty texts."""
    if order not in (2, 3):
        raise ValueError(f"the order is 2 or 3, not {order}")
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("text"))
    size, n = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("text")).first()
    bits = max(2, (max(size, 1) // SLICE_TEXT).bit_length())
    some = texts.where(F.col("text").isNotNull() & drawn(F.col("text"), HEAVY_DOCS, n))
    sample = some.select(F.substring("text", 1, HEAVY_CHARS)).limit(HEAVY_DOCS).collect()
    t = Tokens([r[0].encode() for r in sample])
    seen = np.bincount(t.token, minlength=len(t.words))
    frequent = np.argsort(-seen, kind="stable")[: HEAVY_WORDS - 1]
    frequent = frequent[(seen[frequent] > len(t.token) / (1 << bits) / 8) & (seen[frequent] > 1)]
    heavy = np.unique(np.concatenate([t.words[frequent], np.array([BEGIN], dtype=np.uint64)]))
    model = Model(fresh_path(spark, "lm"), bits, heavy, _heavy_pairs(t, bits) if order == 3 else None)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in slices(batches):
            held += batch.column("text").cast(pa.binary()).to_pylist()
            total += sum(len(x or b"") for x in held[-batch.num_rows :])
            if total > SLICE_TEXT:
                yield from sent(held)
                held, total = [], 0
        if held:
            yield from sent(held)

    def sent(held: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        for b, body in (_triple_messages if order == 3 else _messages)(model, held):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([body], pa.large_binary())], ["bucket", "body"])

    def merge_triples(group: pa.Table) -> pa.Table:
        told = list(_merge_triples(model, group["bucket"][0].as_py(), group["body"].to_pylist()))
        return pa.table({"bucket": pa.array([b for b, _ in told], pa.int64()), "body": pa.array([m for _, m in told], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        if bucket < 0:      # figures, on their way
            return pa.table({"bucket": [bucket], "body": pa.array([_merge_words(model, bucket, group["body"].to_pylist())], pa.binary())})
        told = list(_merge_pairs(model, bucket, group["body"].to_pylist()))
        return pa.table({"bucket": pa.array([b for b, _ in told], pa.int64()), "body": pa.array([m for _, m in told], pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        return pa.table({"bucket": [bucket], "body": pa.array([_merge_words(model, bucket, group["body"].to_pylist())], pa.binary())})

    schema = "bucket bigint, body binary"
    told = texts.mapInArrow(tell, schema)
    if order == 3:
        told = told.groupBy("bucket").applyInArrow(merge_triples, schema)
    told = told.groupBy("bucket").applyInArrow(merge, schema)
    for r in told.groupBy("bucket").applyInArrow(finish, schema).toLocalIterator():     # a few numbers for each bucket
        first, second = (x.tolist() for x in unpacked(r["body"], 2))
        if r["bucket"] == -2:
            model.triple_counts, model.heavy_pair_sums = first, np.array(second, dtype=np.int64)
        elif r["bucket"] < 0:
            model.pair_counts, (model.tokens, model.types, model.pair_types) = first[:4], first[4:]
            model.heavy_sums = np.array(second, dtype=np.int64)
        else:
            model.word_counts = [a + b for a, b in zip(model.word_counts, first)]
            model.word_classes = [a + b for a, b in zip(model.word_classes, second)]
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    A text's words and its end are tokens; A-Z are lower-cased. ``score`` is the log10 probability of the
    whole text, ``base_score`` that by smoothed single words. NULL and empty texts have their end alone. Repeated
    rows score alike, an empty table gives no rows. A model of no text gives every token 1 / (number of types + 1).
    """
    kind = docs.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 * SLICE_BYTES):
            found = model.score(batch.column("text").cast(pa.binary()).to_pylist())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found["n_tokens"]), pa.array(found["n_known"]),
                 pa.array([model.tokens] * n, pa.int64()), pa.array(found["base_score"]), pa.array(found["score"])],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, out)


def op6_kneser_ney(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    model = train(docs.where(~held_out), order=order)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_kneser_ney_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with order three, as production has it; the SQL of ``op6_kneser_ney`` fixes two there."""
    return op6_kneser_ney(spark, sf_dir, order=3)


def _discount_sql(k: int) -> str:
    usual = f"{k} - {k + 1} * (n1::DOUBLE / (n1 + 2 * n2)) * n{k + 1}::DOUBLE / n{k}"
    return f"least(greatest(CASE WHEN n1 > 0 AND n{k} > 0 THEN {usual} ELSE {k / 2} END, {LEAST_DISCOUNT}), {k})::DOUBLE AS d{k}"


_TIMES = ", ".join(f"count(*) FILTER (WHERE n = {k}) AS n{k}" for k in (1, 2, 3, 4))
_DISCOUNTS = ", ".join(_discount_sql(k) for k in (1, 2, 3))
_TAKEN = "CASE WHEN {0} >= 3 THEN {1}d3 WHEN {0} = 2 THEN {1}d2 WHEN {0} = 1 THEN {1}d1 ELSE 0 END".format

#: The end of a text is a space and its beginning two, which no word can be.
SQL = f"""
WITH {CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS r, doc_id, {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held_out,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents, crc_table
), t AS (
  SELECT r, held_out, unnest(list_prepend('  ', words)) AS v, unnest(list_append(words, ' ')) AS w FROM d
), c1 AS (
  SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w
), size AS (
  SELECT coalesce(sum(c), 0)::BIGINT AS tokens, count(*) AS types FROM c1
), c2 AS (
  SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY v, w
), d2 AS (
  SELECT {_DISCOUNTS} FROM (SELECT {_TIMES} FROM c2)
), k AS (
  SELECT w, count(*) AS n FROM c2 GROUP BY w
), d1 AS (
  SELECT {_DISCOUNTS}, coalesce(pairs, 0) AS pairs, m1, m2, m3 FROM (
    SELECT {_TIMES}, sum(n) AS pairs, count(*) FILTER (WHERE n = 1) AS m1, count(*) FILTER (WHERE n = 2) AS m2, count(*) FILTER (WHERE n > 2) AS m3 FROM k)
), x AS (
  SELECT v, sum(n)::DOUBLE AS total,
         (d1 * count(*) FILTER (WHERE n = 1) + d2 * count(*) FILTER (WHERE n = 2) + d3 * count(*) FILTER (WHERE n > 2)) / sum(n) AS weight
  FROM c2, d2 GROUP BY v, d1, d2, d3
), lower AS (
  SELECT w, CASE WHEN pairs > 0
    THEN greatest(coalesce(k.n, 0) - {_TAKEN("coalesce(k.n, 0)", "d1.")}, 0) / pairs + (d1.d1 * m1 + d1.d2 * m2 + d1.d3 * m3) / pairs / (types + 1)
    ELSE 1 / (types + 1)::DOUBLE END AS p
  FROM (SELECT DISTINCT w FROM t) LEFT JOIN k USING (w), d1, size
), s AS (
  SELECT t.r, count(*) AS n_tokens, count(c1.c) AS n_known,
         sum(log10((coalesce(c1.c, 0) + 1)::DOUBLE / (tokens + 1 * (types + 1)))) AS base_score,
         sum(log10(coalesce(greatest(coalesce(c2.n, 0) - {_TAKEN("coalesce(c2.n, 0)", "d2.")}, 0) / x.total, 0) + coalesce(x.weight, 1) * lower.p)) AS score
  FROM t JOIN lower USING (w) LEFT JOIN c1 USING (w) LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN x ON x.v = t.v, d2, size
  GROUP BY t.r
)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, tokens AS train_tokens, base_score, score
FROM d JOIN s USING (r), size
"""
