"""Packing of tokenised documents into fixed-length sequences: bounded-space online best fit.

Each task tokenises its documents (tokenizers, no added special tokens) and ends each with id 0. A
document of more than ``LENGTH`` ids is cut into whole sequences of ``LENGTH`` ids, which are full as they
stand, and one remainder piece. Remainders are placed online: the task keeps at most ``OPEN`` open
sequences, puts a piece into the open one it fills best (the least room that still fits), and when none
fits and all are open, emits the fullest and opens a new one. Memory per task is ``OPEN`` sequences of
piece descriptions, whatever the partition's size.

What stays open at the end of each task is merged afterwards: the open sequences of ``MERGE_TASKS``
neighbouring tasks (at most ``OPEN * MERGE_TASKS`` of them) meet in one group and their pieces are packed
again, first fit by decreasing length. A group is bounded by these two parameters alone.

Defined cases: a NULL text is empty and gives one piece of one id (the 0); a NULL doc_id stays NULL on
its pieces; repeated rows are packed as separate documents; an empty table gives no rows. Only ``doc_id``
and ``text`` of the input are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import process_cache, slices, table
from claimspark.llm.tokens import Codes, Ragged, _byte_level, balanced, id_bytes, ids_after_space, pieces_of
from claimspark.session import materialise

LENGTH = 1024         # ids of a sequence
OPEN = 16             # open sequences a task keeps
MERGE_TASKS = 64      # tasks whose open sequences are merged in one group
BATCH_BYTES = 1 << 20
KNOWN_BYTES = 320 << 20  # pieces and their ids that a worker remembers
PIECE_BYTES = 200        # of a piece besides its characters and ids: object, number, place in the table
END_ID = 0
END_BYTES = np.array([END_ID], dtype="<u4").tobytes()

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("task", pa.int64()), ("open", pa.bool_()),
])
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_DDL = OUT + ", task long, open boolean"


class Ids:
    """Ids of whole texts as the library gives them, each different piece encoded once per worker.

    Where the tokenizer is plain byte-level BPE, a text is cut before each space that stands between two
    characters that are not white space; no token reaches across such a place, so the ids of the pieces,
    one after the other, are the ids of the text. Pieces are numbered as they are first seen, and the ids of
    the new ones of a slice are asked for together; the ids of a text are then gathered by number. The
    numbers are forgotten when they hold ``KNOWN_BYTES``. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark's tasks are the parallelism
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.safe = _byte_level(self.model)
        self.sizes = id_bytes(self.model) if self.safe else None
        self._forget()

    def _forget(self) -> None:
        self.codes, self.ids, self.size = Codes(), Ragged("<u4"), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Ids of the new pieces: a text's first one as it stands (noted as a tuple), any other after its space."""
        new, self.codes.new = self.codes.new, []
        first = np.fromiter((type(p) is tuple for p in new), dtype=bool, count=len(new))
        after = [p for p in new if type(p) is str]
        heads = [p[0] for p in new if type(p) is tuple]
        ids, counts = ids_after_space(self._encode, self.sizes, after)
        parts = [ids]
        for group in balanced([len(p) for p in heads], BATCH_BYTES):
            for j, some in zip(group, self._encode([heads[j] for j in group])):
                heads[j] = some
        parts += [np.array(some, dtype=np.int64) for some in heads]
        n = np.zeros(len(new), dtype=np.int64)
        n[~first], n[first] = counts, [len(some) for some in heads]
        both = Ragged("<u4")
        both.extend(np.concatenate(parts), np.concatenate([n[~first], n[first]]))
        place = np.empty(len(new), dtype=np.int64)
        place[~first], place[first] = np.arange(len(after)), np.arange(len(after), len(new))
        self.ids.extend(*both.take(place))
        self.size += PIECE_BYTES * len(new) + 3 * sum(map(len, after)) + 8 * sum(map(len, heads))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other (little-endian uint32), and where each text's begin."""
        if not self.safe:
            arrays = [np.array(ids, dtype="<u4") for ids in self._encode(texts)]
            flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype="<u4")
            return flat, np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)])
        if self.size > KNOWN_BYTES:
            self._forget()
        parts = [pieces_of(t) for t in texts]
        for some in parts:
            some[0] = (some[0],)
        codes = self.codes.of(parts)
        if self.codes.new:
            self._learn()
        flat, counts = self.ids.take(codes)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat, ends[np.concatenate([[0], np.cumsum([len(some) for some in parts], dtype=np.int64)])]


def _tokenizer(path: str) -> Ids:
    known = process_cache("packing-tokenizers")
    if path not in known:
        known[path] = Ids(path)
    return known[path]


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


class Packer:
    """At most ``open_max`` open sequences; pieces placed by best fit; ``emit`` gets each closed one."""

    def __init__(self, length: int, open_max: int, first_id: int) -> None:
        self.length, self.open_max, self.next_id = length, open_max, first_id
        self.open: list[list] = []          # [used, sequence_id, pieces]

    def _new(self) -> list:
        seq = [0, self.next_id, []]
        self.next_id += 1
        return seq

    def place(self, piece: tuple, size: int) -> list[list]:
        """Put a piece; return the sequences that this closes."""
        closed = []
        if size >= self.length:
            seq = self._new()
            seq[0], seq[2] = size, [(piece, 0)]
            return [seq]
        fits = [s for s in self.open if s[0] + size <= self.length]
        if fits:
            seq = max(fits, key=lambda s: (s[0], -s[1]))
        else:
            if len(self.open) >= self.open_max:
                fullest = max(self.open, key=lambda s: (s[0], -s[1]))
                self.open.remove(fullest)
                closed.append(fullest)
            seq = self._new()
            self.open.append(seq)
        seq[2].append((piece, seq[0]))
        seq[0] += size
        if seq[0] == self.length:
            self.open.remove(seq)
            closed.append(seq)
        return closed


def _rows(seqs: list[list], task: int, still_open: bool) -> dict[str, list]:
    out = {name: [] for name in PIECES.names}
    for _, seq_id, pieces in seqs:
        for (doc_id, start, length, crc, doc_tokens), offset in pieces:
            for name, value in zip(PIECES.names, (doc_id, start, length, crc, doc_tokens, seq_id, offset, task, still_open)):
                out[name].append(value)
    return out


def _pack_task(path: str, length: int, open_max: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        model = _tokenizer(path)
        packer = Packer(length, open_max, task << 32)
        for part in slices(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            flat, bounds = model.encode(texts)
            closed = []
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                first, n = int(bounds[k]), int(bounds[k + 1] - bounds[k]) + 1      # and the end id
                for start in range(0, n, length):
                    stop = min(start + length, n)
                    crc = zlib.crc32(memoryview(flat[first + start : first + min(stop, n - 1)]))
                    if stop == n:
                        crc = zlib.crc32(END_BYTES, crc)
                    closed += packer.place((doc_id, start, stop - start, crc, n), stop - start)
            if closed:
                yield pa.RecordBatch.from_pydict(_rows(closed, task, False), schema=PIECES)
        if packer.open:
            yield pa.RecordBatch.from_pydict(_rows(packer.open, task, True), schema=PIECES)

    return run


def _merge(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """First fit by decreasing length over the pieces of the open sequences of a few tasks."""
        order = group.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        first = (1 << 62) | (int(group["task"].iloc[0]) // MERGE_TASKS << 32)
        used: list[int] = []
        seq = np.zeros(len(order), dtype=np.int64)
        offset = np.zeros(len(order), dtype=np.int64)
        for i, size in enumerate(order["length"].to_numpy()):
            for s, u in enumerate(used):
                if u + size <= length:
                    break
            else:
                s = len(used)
                used.append(0)
            seq[i], offset[i] = first + s, used[s]
            used[s] += int(size)
        return order.assign(sequence_id=seq, offset=offset)[OUT_NAMES]

    return run


OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, open_max: int = OPEN) -> DataFrame:
    """One row per piece (see the module's docstring): ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialise(source.mapInArrow(_pack_task(tokenizer_path, length, open_max), PIECES_DDL), "packing-pieces")
    closed = packed.where(~F.col("open")).select(*OUT_NAMES)
    merged = (
        packed.where(F.col("open"))
        .groupBy((F.col("task") / MERGE_TASKS).cast("bigint").alias("group"))
        .applyInPandas(_merge(length), OUT)
    )
    return closed.unionByName(merged)


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
