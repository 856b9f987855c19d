"""Token counts of whole texts: batches of a tokenizer library inside Arrow functions, lengths only.

Where the tokenizer allows it, texts are split at safe boundaries, at which no token can reach
across. The pieces are mostly words, so a worker encodes each different one once per few megabytes
and adds up lengths; a very long text is no different from many short ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import process_cache, slices, table

BATCH_BYTES = 1 << 20      # text encoded in one call
KNOWN_PIECES = 300_000     # lengths that a worker remembers, some 50 MB

#: Before a space that stands between two characters that are not white space. Byte-level
#: pre-tokenizers with the usual pattern start a new word there, and never look behind it.
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: a space beside white space, or at either end: such a text is cut at ``SAFE`` places only
UNSAFE = re.compile(r"(?:^|\s) | (?=\s|$)")
TWO_SPACES = re.compile(r"\s\s")
JOINED_BYTES = 1 << 17     # pieces encoded as one text


class Encoder:
    """Counts tokens as the library of the file does, without added begin or end tokens.

    ``.json`` files are read by tokenizers, ``.model`` files by sentencepiece. Special strings in a
    text are handled as the library does by default; nothing is truncated or padded.
    """

    def __init__(self, path: str) -> None:
        self.safe, self.whole, self.after_space = False, {}, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.safe = _byte_level(model)

    def learn(self, texts: set[str], known: dict[str, int], before: str, batch_bytes: int) -> None:
        """Note the lengths of the texts that are new, with ``before`` in front of each."""
        new = list(texts.difference(known))
        for group in balanced([len(t) for t in new], batch_bytes):
            some = [new[j] for j in group]
            known.update(zip(some, self.lengths([before + t for t in some])))

    def counts(self, texts: list[str], batch_bytes: int) -> list[int]:
        """Tokens of each text."""
        if not self.safe:
            n = [0] * len(texts)
            for group in balanced([len(t) for t in texts], batch_bytes):
                for j, length in zip(group, self.lengths([texts[j] for j in group])):
                    n[j] = length
            return n
        if len(self.whole) + len(self.after_space) > KNOWN_PIECES:
            self.whole.clear()
            self.after_space.clear()
        parts = [t.split(" ") for t in texts]
        every = {p for some in parts for p in some}
        # a text with white space next to a space is not safe at every space: search it in full
        unsafe = {p for p in every if not p or p[0].isspace() or p[-1].isspace()}
        plain = [unsafe.isdisjoint(some) for some in parts]
        cut = [[some[0]] if ok else SAFE.split(t) for t, some, ok in zip(texts, parts, plain)]
        self.learn({p for some in cut for p in some}, self.whole, "", batch_bytes)
        self.learn(every - unsafe, self.after_space, " ", batch_bytes)
        whole, after = self.whole.__getitem__, self.after_space.__getitem__
        return [
            sum(map(whole, first)) + (sum(map(after, some[1:])) if ok else 0)
            for first, some, ok in zip(cut, parts, plain)
        ]


def pieces_of(text: str) -> list[str]:
    """The text cut at ``SAFE`` places: its first piece as it stands, the others without the space before them."""
    if TWO_SPACES.search(text) is None and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")     # no white space beside a space: every space is such a place
    if UNSAFE.search(text) is None:
        return text.split(" ")
    first, *rest = SAFE.split(text)
    return [first, *(p[1:] for p in rest)]


class Codes(dict):
    """Numbers of pieces in the order first seen. A look-up of a piece not seen before numbers it and notes it in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, piece) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code

    def of(self, parts: list[list]) -> np.ndarray:
        """The numbers of all pieces, one after the other."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=sum(map(len, parts)))


class Ragged:
    """Rows of numbers of different lengths: appended at the end, gathered by row number."""

    def __init__(self, dtype) -> None:
        self.values, self.ends = np.zeros(1 << 12, dtype=dtype), np.zeros(1 << 12, dtype=np.int64)
        self.rows = self.size = 0

    def extend(self, values: np.ndarray, counts: np.ndarray) -> None:
        rows, size = self.rows + len(counts), self.size + len(values)
        if size > len(self.values):
            self.values = np.concatenate([self.values[: self.size], np.zeros(size, dtype=self.values.dtype)])
        if rows > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.rows], np.zeros(rows, dtype=np.int64)])
        self.values[self.size : size] = values
        self.ends[self.rows : rows] = self.size + np.cumsum(counts)
        self.rows, self.size = rows, size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows one after the other, and how many each has."""
        starts = np.where(rows > 0, self.ends[rows - 1], 0)
        counts = self.ends[rows] - starts
        ends = np.cumsum(counts)
        at = np.repeat(starts - (ends - counts), counts)
        at += np.arange(len(at))
        return self.values[at], counts


def id_bytes(model) -> np.ndarray:
    """How many bytes of text each id of a byte-level tokenizer stands for (a character of its vocabulary is a byte)."""
    sizes = np.zeros(model.get_vocab_size(with_added_tokens=True), dtype=np.int64)
    for piece, i in model.get_vocab(with_added_tokens=False).items():
        sizes[i] = len(piece)
    for i, added in model.get_added_tokens_decoder().items():
        sizes[i] = len(added.content.encode())
    return sizes


def _each(encode: Callable[[list[str]], list], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids = encode(texts)
    counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(counts.sum())), counts


def _joined(encode: Callable[[list[str]], list], sizes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    text = " " + " ".join(pieces)
    if TWO_SPACES.search(text) is None and text[-1] != " ":       # each space in it is a SAFE place
        ids = np.array(encode([text])[0], dtype=np.int64)
        long = np.fromiter(map(len, pieces if text.isascii() else map(str.encode, pieces)), dtype=np.int64, count=len(pieces))
        reach, ends = np.cumsum(sizes[ids]), np.cumsum(long + 1)
        last = np.searchsorted(reach, ends)
        if len(ids) and reach[-1] == ends[-1] and np.array_equal(reach[last], ends):
            return ids, np.diff(last, prepend=-1)
    return _each(encode, [" " + p for p in pieces])


def ids_after_space(encode: Callable[[list[str]], list], sizes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, each with a space before it, and how many ids each has.

    Some ``JOINED_BYTES`` of pieces at a time are encoded as one text, which is cut into the pieces' ids again
    by the ids' ``sizes`` in bytes; where a piece begins or ends with white space, each for itself.
    """
    if not pieces:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    long = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(long + 1) // JOINED_BYTES)) + 1).tolist(), len(pieces)]
    found = [_joined(encode, sizes, pieces[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])


def encoder_for(path: str) -> Encoder:
    """The worker's encoder; it stays loaded from task to task."""
    known = process_cache("encoders")
    if path not in known:
        known.clear()
        known[path] = Encoder(path)
    return known[path]


def _byte_level(model) -> bool:
    """Whether texts may be cut at ``SAFE``: plain byte-level splitting, no normaliser, no token with a space."""
    import json

    plan = json.loads(model.to_str())
    splitter = plan.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    added = plan.get("added_tokens") or []
    whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and " " not in t["content"] for t in added)
    return bool(plain and whole and not plan.get("normalizer") and not plan.get("post_processor"))


def balanced(sizes: list[int], limit: int) -> list[list[int]]:
    """Group indexes, longest texts first, so that no batch holds much more than ``limit`` bytes."""
    batches, room = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if not batches or room + sizes[i] > limit:
            batches.append([])
            room = 0
        batches[-1].append(i)
        room += sizes[i]
    return batches


def count_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, by the tokenizer file at ``path``.

    The file must lie on every worker. NULL and empty texts have no tokens; repeated rows are counted
    each; an empty table gives no rows; other columns are not read. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 * batch_bytes):
            n = encoder_for(path).counts([t or "" for t in batch.column("text").to_pylist()], batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text).alias("text"),
    ).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
