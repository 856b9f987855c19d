"""Online packing: every id in exactly one piece, sequences within their length, little padding."""

import zlib

import numpy as np
import pytest

from claimspark.llm import packing


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, path, length):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    want = {}
    for doc_id, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault(doc_id, []).append(ids)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for doc_id, copies in want.items():
        pieces = got[doc_id]
        # repeated ids: each copy is covered once; group the pieces of equal copies by their start
        assert sum(p.length for p in pieces) == sum(len(c) for c in copies)
        for p in pieces:
            assert any(p.doc_tokens == len(c) and zlib.crc32(np.asarray(c[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                       for c in copies)
        starts = sorted((p.doc_tokens, p.start, p.length) for p in pieces)
        for c in copies:
            cover = [s for s in starts if s[0] == len(c)]
            assert sum(s[2] for s in cover) % len(c) == 0
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= length
    return by_seq


def test_covers_every_id(spark, path, odd_docs):
    rows = packing.pack_documents(odd_docs, path, length=64, open_max=3).collect()
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(rows, docs, path, 64)


def test_little_padding(spark, path):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 400))))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(df, path).collect()
    by_seq = check(rows, docs, path, 1024)
    used = sum(r.length for r in rows)
    assert used / (1024 * len(by_seq)) > 0.9


def test_packer_is_bounded():
    p = packing.Packer(10, 2, 0)
    closed = []
    for size in [6, 6, 6, 3, 4, 10, 1]:
        closed += p.place(("d", 0, size, 0, size), size)
        assert len(p.open) <= 2
    assert [s[0] for s in closed] == [6, 10, 10, 10]


def test_empty(spark, path, no_docs):
    assert packing.pack_documents(no_docs, path).collect() == []


def test_ids_of_pieces_are_the_library_ids(path, odd_docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    texts = [r.text or "" for r in odd_docs.collect()] + [
        "a <|endoftext|> b<|endoftext|>c", "x  y\\n z \\t w", "  lead and trail  ", "数据 和 文本", "it's 12,345.6 ok?!",
    ]
    ids = packing.Ids(path)
    assert ids.safe
    for _ in range(2):      # second time from the table of known pieces
        flat, bounds = ids.encode(texts)
        got = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_new_words_of_a_slice_are_encoded_as_one_text(path):
    """The library is called for a slice's new words together, not with a text for each of them."""
    ids = packing.Ids(path)
    given = []

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            given.extend(texts)
            return model.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    model, ids.model = ids.model, Counted()
    texts = [" ".join(f"word{i}, näme{i}." for i in range(k, k + 500)) for k in (0, 250)]
    for _ in range(2):
        flat, bounds = ids.encode(texts)
        got = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert len(given) == 3      # two first words, and the others


def test_words_that_end_in_white_space_are_encoded_alone(path):
    ids = packing.Ids(path)
    pieces = ["plain", "line\n", "\n", "", "tab\t", "x y", "数据", "<|endoftext|>", "last"]
    flat, counts = packing.ids_after_space(ids._encode, ids.sizes, pieces)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ids._encode([" " + p for p in pieces])
