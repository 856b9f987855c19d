"""Cross-tokeniser alignment against plain set intersection of end offsets and dictionary counts."""

import hashlib
from itertools import accumulate

import pytest

from claimspark.llm import alignment


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers

    return alignment.Tokenisers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plain(tok, text):
    if not text:
        return None
    a = tok.a.encode(" " + text, add_special_tokens=False).ids
    b = tok.b.encode(text)
    whole = b" " + text.encode()
    if b"".join(tok.a_bytes[t] for t in a) != whole or b"".join(tok.b_bytes[t] for t in b) != whole:
        return None
    ea, eb = list(accumulate(len(tok.a_bytes[t]) for t in a)), list(accumulate(len(tok.b_bytes[t]) for t in b))
    cuts = sorted(set(ea) & set(eb))
    groups = []
    for lo, hi in zip([0, *cuts], cuts):
        ga = [t for t, e, s in zip(a, ea, [0, *ea]) if lo < e <= hi]
        gb = [t for t, e in zip(b, eb) if lo < e <= hi]
        groups.append((ga, gb))
    return a, b, groups


def brute(tok, docs):
    per, counts = [], {}
    for doc_id, text in docs:
        found = plain(tok, text)
        if found is None:
            per.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b, groups = found
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
        text_ = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        per.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text_.encode()).hexdigest()))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (d, na, nb, ng, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), h)
        for d, na, nb, ng, ls, h in per
    ]


DOCS = [
    (1, "Hello world, this is a test of alignment."), (2, "Hello world, this is a test of alignment."),
    (3, "naïve café – déjà vu <|endoftext|> and <s> stay text"), (4, ""), (5, None), (None, "without an id 12345"),
    (6, "   several   spaces\tand\ttabs\nnew lines\n\n"), (7, "数据 和 文本 😀 emoji"), (8, "x" * 3000 + " tail"),
    (9, " ".join(f"word{i % 97}ing" for i in range(2000))),
]


def test_groups_agree_with_plain_cuts(tok):
    for _, text in DOCS:
        found = plain(tok, text)
        n_a, n_b, n_groups, n_links, groups, _ = alignment.align_text(tok, text)
        if found is None:
            assert (n_a, groups) == (0, "")
            continue
        a, b, want = found
        assert groups == ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in want)
        assert n_groups == len(want)


def test_diagonal_groups_cover():
    ea, eb = [1, 3, 5, 6, 8, 9, 10], [1, 2, 5, 6, 7, 8, 10]
    got = alignment.diagonal_groups(ea, eb)
    assert got == [(0, 1, 0, 1, True), (1, 3, 1, 3, False), (3, 4, 3, 4, True), (4, 5, 4, 6, False), (5, 7, 6, 7, False)]


def test_documents(spark, tok):
    import public_tokenizers

    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("pairs", __import__("pyspark.sql.functions").sql.functions.lit("x"))
    got = alignment.align_documents(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rows = list(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(rows, key=key) == sorted(brute(tok, DOCS), key=key)
    rows = {r[0]: r for r in rows}
    assert rows[4][-1] == "" and rows[5][-1] == "" and rows[4][1] == 0


def test_empty(spark, no_docs):
    import public_tokenizers

    got = alignment.align_documents(no_docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.collect() == []


def test_each_piece_is_tokenised_once(tok):
    """Words seen before are not given to the tokenisers again, and texts are put together from them as if whole."""
    texts = [t for _, t in DOCS] + [" lead", "trail ", "a  b \n c", "in ▁ it", "in▁ it", "▁", "\nx y\n", "<s> <unk> <|endoftext|>x"]
    aligner = alignment.Aligner(tok)
    given = []

    class Counted:
        def encode(self, pieces, num_threads):
            given.extend(pieces)
            return tok.b.encode(pieces, num_threads=num_threads)

    class Tok:
        def __getattr__(self, name):
            return Counted() if name == "b" else getattr(tok, name)

    aligner.tok = Tok()
    for _ in range(2):
        rows, groups, pairs, mults, n_pairs = aligner.align(texts)
        ends = n_pairs.cumsum()
        for text, row, group, end, n in zip(texts, rows.tolist(), groups, ends, n_pairs):
            *want, want_group, links = alignment.align_text(tok, text)
            assert (row, group) == (want, want_group)
            counts = {}
            for link in links.tolist():
                counts[link] = counts.get(link, 0) + 1
            assert dict(zip(pairs[end - n : end].tolist(), mults[end - n : end].tolist())) == counts
    assert len(given) == len(set(given)) < 300      # DOCS repeat 97 words 2,000 times


def test_whole_texts_where_they_may_not_be_cut(tok, monkeypatch):
    monkeypatch.setattr(tok, "safe", False)
    rows, groups, *_ = alignment.Aligner(tok).align([t for _, t in DOCS])
    assert [(*r, g) for r, g in zip(rows.tolist(), groups)] == [alignment.align_text(tok, t)[:5] for _, t in DOCS]
