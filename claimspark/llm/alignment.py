"""Alignment of two tokenisations of the same bytes: diagonal run skipping over end offsets.

Tokeniser A encodes space + text, tokeniser B the text (it adds the space itself). Each token covers a
run of bytes; the byte offsets where both an A token and a B token end cut the tokens into groups.
Walking both arrays of end offsets at the current index shift, exponential probing (1, 2, 4, ... ends,
each stretch compared at once) jumps over stretches where the two arrays agree end for end, that is
one-to-one groups. Where they disagree, the group is resolved locally by merging the two arrays up to
the next common end, and the shift between the indexes takes its new value from there.

Where both tokenisers allow it, a text is cut before each space that stands between two characters that are
not white space: no token of either reaches across such a place, so both have an end there and no group does
either. Each different piece is then tokenised and walked once per worker: the pieces that a slice of texts
brings anew are laid end to end and walked as one run of bytes, and a document's tokens, groups and links are
those of its pieces, one after the other. Other tokenisers are given whole texts.

Every A-B token occurrence pair inside one group is a link. A corpus-wide count of an id pair is the
number of documents that hold it linked: documents send their distinct pairs, which are counted with
partial aggregation, so a pair that nearly every document holds is summed map-side. The table of counts
grows with the pairs that the two vocabularies form, not with the documents; it is broadcast only while
it has at most ``BROADCAST_PAIRS`` rows, and joined by a shuffle (with adaptive splitting of hot pairs)
beyond that.

Defined cases: texts that are NULL or empty, or whose joined A or B bytes differ from space + text, have
no tokens: zeros and ``groups_sha256`` ''. A NULL doc_id stays NULL. Repeated rows are separate
documents and each counts as one in the corpus-wide counts. Special tokens' strings inside a text are
plain text. Only ``doc_id`` and ``text`` are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import process_cache, slices, table
from claimspark.llm.tokens import Codes, Ragged, _byte_level, ids_after_space, pieces_of
from claimspark.session import materialise

BATCH_BYTES = 1 << 20
KNOWN_BYTES = 160 << 20     # aligned pieces that a worker remembers
PIECE_BYTES = 320           # of a piece besides its characters, groups text and links
BROADCAST_PAIRS = 2_000_000

ALIGNED = (
    "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, mults array<long>"
)


def byte_level_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level BPE vocabularies, inverted.

    Bytes that are printable in Latin-1 (``!`` to ``~``, ``¡`` to ``¬``, ``®`` to ``ÿ``) stand for
    themselves; the others take the code points from 256 upwards, in byte order.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, extra = {}, 0
    for b in range(256):
        if b in printable:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


class Tokenisers:
    """The two encoders and the bytes of every id of each."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = []
        for i in range(size):
            piece = self.a.id_to_token(i) or ""
            self.a_bytes.append(bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.names = np.array([str(i) for i in range(max(size, len(self.b_bytes)))], dtype=object)
        self.safe = _byte_level(self.a) and _cut_at_spaces(self.b)


def _cut_at_spaces(model) -> bool:
    """Whether a sentencepiece model's tokens stay within words: BPE on the text as it is, no piece with a space after another character."""
    try:
        from sentencepiece import sentencepiece_model_pb2 as layout
    except ImportError:
        return False
    plan = layout.ModelProto()
    plan.ParseFromString(model.serialized_model_proto())
    text, how = plan.normalizer_spec, plan.trainer_spec
    as_it_is = not text.precompiled_charsmap and not text.remove_extra_whitespaces
    prefixed = text.add_dummy_prefix and text.escape_whitespaces and not how.treat_whitespace_as_suffix
    own = any(p.type == layout.ModelProto.SentencePiece.USER_DEFINED for p in plan.pieces)
    within = all("▁" not in p.piece[1:] or not p.piece.strip("▁") for p in plan.pieces)
    return bool(how.model_type == layout.TrainerSpec.BPE and as_it_is and prefixed and within and not own)


def _tokenisers(path_a: str, path_b: str) -> Tokenisers:
    known = process_cache("alignment-tokenisers")
    if (path_a, path_b) not in known:
        known[(path_a, path_b)] = Tokenisers(path_a, path_b)
    return known[(path_a, path_b)]


def diagonal_groups(ea: list[int], eb: list[int]) -> list[tuple[int, int, int, int, bool]]:
    """Groups of two strictly increasing end arrays with the same last end.

    Each group is ``(a0, a1, b0, b1, diagonal)``: A tokens ``a0:a1`` and B tokens ``b0:b1``. A diagonal
    entry is a stretch of one-to-one groups (A token ``a0 + t`` with B token ``b0 + t``).
    """
    na, nb = len(ea), len(eb)
    i = j = 0
    out = []
    while i < na and j < nb:
        if ea[i] == eb[j]:
            run, step = 1, 1
            while True:
                width = min(step, na - i - run, nb - j - run)
                if width <= 0:
                    break
                if ea[i + run : i + run + width] == eb[j + run : j + run + width]:
                    run += width
                    step <<= 1
                    continue
                lo, hi = 0, width              # the first lo ends agree, the first hi do not
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    if ea[i + run : i + run + mid] == eb[j + run : j + run + mid]:
                        lo = mid
                    else:
                        hi = mid
                run += lo
                break
            out.append((i, i + run, j, j + run, True))
            i, j = i + run, j + run
        else:
            pi, pj = i, j
            while ea[pi] != eb[pj]:
                if ea[pi] < eb[pj]:
                    pi += 1
                else:
                    pj += 1
            out.append((i, pi + 1, j, pj + 1, False))
            i, j = pi + 1, pj + 1
    return out


def align_text(tok: Tokenisers, text: str | None, a_ids: list[int] | None = None, b_ids: list[int] | None = None):
    """``n_a, n_b, n_groups, n_links, groups text, link keys (a << 32 | b, one per link)`` of one text."""
    if not text:
        return 0, 0, 0, 0, "", np.zeros(0, dtype=np.int64)
    whole = b" " + text.encode()
    a_ids = a_ids if a_ids is not None else tok.a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b_ids if b_ids is not None else tok.b.encode(text)
    a, b = np.asarray(a_ids, dtype=np.int64), np.asarray(b_ids, dtype=np.int64)
    ea, eb = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
    if (not len(a) or not len(b) or ea[-1] != len(whole) or eb[-1] != len(whole)
            or b"".join(map(tok.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(tok.b_bytes.__getitem__, b_ids)) != whole):
        return 0, 0, 0, 0, "", np.zeros(0, dtype=np.int64)
    ga, gb, links, _, both = _groups(tok, a, b, ea, eb)
    return len(a), len(b), int(ga[-1]) + 1, len(links), "".join(both)[:-1], links


def _groups(tok: Tokenisers, a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray):
    """Of ids and their end offsets: group of each A and B token, link keys, links of each group, and the groups as text.

    The text is a list of every token's id and the mark after it, groups in turn, A ids before B ids.
    """
    # group number of every token: a diagonal stretch is one group per token, an irregular group one in all
    ga, gb = np.empty(len(a), dtype=np.int64), np.empty(len(b), dtype=np.int64)
    n_groups = 0
    for a0, a1, b0, b1, diagonal in diagonal_groups(ea.tolist(), eb.tolist()):
        if diagonal:
            ga[a0:a1] = gb[b0:b1] = np.arange(n_groups, n_groups + a1 - a0)
            n_groups += a1 - a0
        else:
            ga[a0:a1], gb[b0:b1] = n_groups, n_groups
            n_groups += 1
    size_a, size_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    start_a = np.concatenate([[0], np.cumsum(size_a)[:-1]])
    start_b = np.concatenate([[0], np.cumsum(size_b)[:-1]])
    # every A-B pair inside a group
    per = size_a * size_b
    g = np.repeat(np.arange(n_groups), per)
    k = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    links = (a[start_a[g] + k // size_b[g]] << 32) | b[start_b[g] + k % size_b[g]]
    # the groups as text: A ids, then B ids, of each group in turn
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    order = np.argsort(2 * np.concatenate([ga, gb]) + side, kind="stable")
    last_of_side = np.concatenate([np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)])
    marks = MARKS[np.where(last_of_side, 1 + side, 0)]
    both = np.empty(2 * len(order), dtype=object)
    both[0::2], both[1::2] = tok.names[np.concatenate([a, b])][order], marks[order]
    return ga, gb, links, per, both.tolist()


MARKS = np.array([",", "|", ";"], dtype=object)


class Aligner:
    """Alignments of whole texts, put together from pieces that are each aligned once, until ``KNOWN_BYTES`` are held."""

    def __init__(self, tok: Tokenisers) -> None:
        self.tok = tok
        self._forget()

    def _forget(self) -> None:
        self.codes, self.links, self.sizes = Codes(), Ragged(np.int64), Ragged(np.int64)
        self.groups: list[str] = []
        self.held = 0

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of the pieces, one after the other, and how many each piece has."""
        tok = self.tok
        if tok.safe:
            a, n_a = ids_after_space(self._encode_a, tok.a_len, pieces)
        else:
            found = self._encode_a([" " + p for p in pieces])
            a, n_a = np.array([*chain.from_iterable(found)], dtype=np.int64), np.array([*map(len, found)], dtype=np.int64)
        found = tok.b.encode(pieces, num_threads=1)
        return a, n_a, np.array([*chain.from_iterable(found)], dtype=np.int64), np.array([*map(len, found)], dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        tok = self.tok
        a, n_a, b, n_b = self._ids(pieces)
        whole = [b" " + p.encode() for p in pieces]
        size = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        a_bytes, b_bytes = [*map(tok.a_bytes.__getitem__, a.tolist())], [*map(tok.b_bytes.__getitem__, b.tolist())]
        all_bytes, reach = b"".join(whole), np.cumsum(size)
        ea, eb = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
        fits = n_a.all() and n_b.all() and np.array_equal(ea[ends_a - 1], reach) and np.array_equal(eb[ends_b - 1], reach)
        if not (fits and b"".join(a_bytes) == all_bytes and b"".join(b_bytes) == all_bytes):
            # some piece is not what its tokens stand for: it is left out, and so is each text that holds it
            good = np.array([
                bool(x and y) and b"".join(a_bytes[i - x : i]) == w and b"".join(b_bytes[j - y : j]) == w
                for w, i, x, j, y in zip(whole, ends_a.tolist(), n_a.tolist(), ends_b.tolist(), n_b.tolist())
            ], dtype=bool)
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
            ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
            ea, eb = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
        if len(a):
            ga, _, links, per, both = _groups(tok, a, b, ea, eb)
        else:
            ga, links, per, both = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        # groups of each piece, then their links and their text
        upto = np.concatenate([[0], ga + 1])[ends_a]
        n_groups = np.diff(upto, prepend=0)
        n_links = np.diff(np.concatenate([[0], np.cumsum(per)])[upto], prepend=0)
        cuts = [0, *(2 * (ends_a + ends_b)).tolist()]
        self.groups += ["".join(both[i:j])[:-1] for i, j in zip(cuts[:-1], cuts[1:])]
        width = len(tok.b_bytes)
        self.links.extend((links >> 32) * width + (links & 0xFFFFFFFF), n_links)
        self.sizes.extend(np.stack([n_a, n_b, n_groups, n_links], axis=1).ravel(), np.full(len(pieces), 4))
        self.held += PIECE_BYTES * len(pieces) + int(size.sum()) + sum(map(len, both)) + 8 * len(links)

    def align(self, texts: list[str | None]):
        """Of each text ``n_a, n_b, n_groups, n_links`` (an array of rows) and its groups' text; of all, one after the other,
        the distinct link keys with their numbers of occurrences, and how many of them each text has."""
        if self.held > KNOWN_BYTES:
            self._forget()
        parts = [[] if not t else pieces_of(t) if self.tok.safe else [t] for t in texts]
        codes = self.codes.of(parts)
        new, self.codes.new = self.codes.new, []
        for group in _runs(new):
            self._learn(group)
        n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        owner = np.repeat(np.arange(len(texts)), n)
        sizes = self.sizes.take(codes)[0].reshape(-1, 4)
        broken = np.bincount(owner, sizes[:, 0] == 0, minlength=len(texts)) > 0
        if broken.any():
            keep = ~broken[owner]
            codes, owner, sizes, n = codes[keep], owner[keep], sizes[keep], np.where(broken, 0, n)
        rows = np.zeros((len(texts), 4), dtype=np.int64)
        some = np.flatnonzero(n)
        cuts = np.concatenate([[0], np.cumsum(n)])
        if len(some):
            rows[some] = np.add.reduceat(sizes, cuts[some], axis=0)
        names = [*map(self.groups.__getitem__, codes.tolist())]
        cuts = cuts.tolist()
        groups = [";".join(names[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        # the links of a text, equal ones counted
        found, per = self.links.take(codes)
        width = len(self.tok.b_bytes)
        span = len(self.tok.a_bytes) * width
        found += np.repeat(owner * span, per)
        found.sort()
        first = np.flatnonzero(np.diff(found, prepend=-1))
        mults = np.diff(first, append=len(found))
        found = found[first]
        of = found // span
        found -= of * span
        return rows, groups, (found // width << 32) | found % width, mults, np.bincount(of, minlength=len(texts))


def _runs(pieces: list[str]) -> Iterator[list[str]]:
    """The pieces in their order, about ``BATCH_BYTES`` of text at a time."""
    run, room = [], 0
    for p in pieces:
        if run and room + len(p) > BATCH_BYTES:
            yield run
            run, room = [], 0
        run.append(p)
        room += len(p)
    if run:
        yield run


def _aligner(path_a: str, path_b: str) -> Aligner:
    known = process_cache("aligners")
    if (path_a, path_b) not in known:
        known[(path_a, path_b)] = Aligner(_tokenisers(path_a, path_b))
    return known[(path_a, path_b)]


def _align_task(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for part in slices(batches, "text", BATCH_BYTES):
            rows, groups, pairs, mults, n_pairs = aligner.align(part.column("text").to_pylist())
            hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_pairs)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("doc_id"), *map(pa.array, rows.T), pa.array(hashes, pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(mults))],
                ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "mults"],
            )

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    source = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    aligned = materialise(source.mapInArrow(_align_task(path_a, path_b), ALIGNED), "alignment-docs")
    links = aligned.select("rid", F.explode(F.arrays_zip("pairs", "mults")).alias("l")).select(
        "rid", F.col("l.pairs").alias("pair"), F.col("l.mults").alias("mult")
    )
    counts = links.groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn(
        "best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    )
    counts = materialise(counts, "alignment-counts")
    n_pairs = counts.count()
    side = F.broadcast(counts) if n_pairs <= BROADCAST_PAIRS else counts
    per_doc = links.join(side, "pair").groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("mult")).otherwise(0)).alias("n_best"),
        F.sum(F.col("mult") * F.col("n_docs")).alias("count_sum"),
    )
    return aligned.join(per_doc, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"),
        "groups_sha256",
    )


def op12_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
    )
