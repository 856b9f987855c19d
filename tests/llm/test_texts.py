"""Operators on texts: small cases with known answers, and brute force on random ones."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import common, decontaminate, langid, lm, minhash, mixing, sharding, suffixes, tokens
from claimspark.llm.components import connected_components

from .conftest import LINE


def test_words_match_a_plain_split():
    texts = [b"One two\tTHREE", None, b"", b"  \n ", "é É x\x85y".encode(), b"a" * 5000]
    w = common.words_of(texts)
    for i, t in enumerate(texts):
        some = slice(w.offsets[i], w.offsets[i + 1])
        found = [bytes(w.data[a:b]) for a, b in zip(w.starts[some], w.ends[some])]
        assert found == (t or b"").lower().split()
    again = common.words_of([b"x one two three y"])
    assert list(again.hashes[1:4]) == list(w.hashes[:3])


def test_fold(spark):
    got = spark.range(50).select("id", common.fold_of(F.col("id"), 7)).collect()
    assert all(f == zlib.crc32(str(i).encode()) % 7 for i, f in got)


# ---------------------------------------------------------------- tokens


def test_token_counts_are_the_library_s(spark, odd_docs, no_docs):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    extra = ["a  b", " lead", "tail ", "it's 's don 't", "<|endoftext|> x<|endoftext|>", "x  y  z", "tab \t x", "½ ² 3 x", "a\x1c b"]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    rows = tokens.count_tokens(docs, path, batch_bytes=1000).join(docs, "doc_id").collect()
    for r in rows:
        if sum(i == r.doc_id for i, _ in texts) == 1:
            assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids), r.text
            assert r.n_bytes == len((r.text or "").encode())
    assert tokens.count_tokens(no_docs, path).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(1, "Some words, twice. Some words"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}
    assert got == {i: tokens.Encoder(path).lengths([t])[0] for i, t in ((1, "Some words, twice. Some words"), (2, ""), (3, ""))}


# ---------------------------------------------------------------- repeats


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, 1 << 63), suffixes.LAST if i is None else i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), suffixes.LAST if i is None else i
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < own:
                gone[k : k + 50] = True
        edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out.append((i, spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def test_repeats_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE_TEXT", 2000)     # many slices and buckets
    rng = random.Random(3)
    shared = ["".join(rng.choice("ab ") for _ in range(rng.randrange(40, 140))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 90))) for _ in range(rng.randrange(0, 5))]
        rows.append((rng.choice([i, i, i, 7, None]), "".join(parts)))
    rows += [(200, "a" * 300), (201, "a" * 49), (202, "a" * 51), (203, "ab" * 200), (204, "b" + "ab" * 30), (205, None), (206, ""), (207, rows[3][1]), (207, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()), key=repr)
    assert got == brute_repeats(rows)


def test_repeats_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in suffixes.remove_repeats(odd_docs).collect() if r.doc_id}
    assert got[1].spans == [] and bytes(got[2].kept) == b"" and bytes(got[3].kept) == LINE.upper().encode()
    assert len(got[9].kept) < 60 and got[8].spans == []
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_suffix_order_is_sorted():
    rows = np.zeros((2, 88), dtype=np.uint8)
    rows[0, :60], rows[1, :60] = np.arange(60) % 7, np.arange(60) % 7
    order, begins = suffixes.suffix_order(rows, np.array([[0, 0], [0, 1], [1, 0]]), np.array([5, 5, 2]))
    assert order.tolist() == [2, 0, 1] and begins.tolist() == [True, False, True]


# ---------------------------------------------------------------- language model


def brute_lm(train, texts):
    import collections
    import math

    c1, c2 = collections.Counter(), collections.Counter()
    for t in train:
        w = [*(t or "").encode().lower().split(), "END"]
        c1.update(w)
        c2.update(zip(["BEGIN", *w], w))
    n, v, after, followers = sum(c1.values()), len(c1), collections.Counter(w for _, w in c2), collections.defaultdict(list)
    for (x, _), k in c2.items():
        followers[x].append(k)
    d2, d1 = (lm.discounts([sum(k == j for k in c.values()) for j in (1, 2, 3, 4)]) for c in (c2, after))
    for t in texts:
        w = [*(t or "").encode().lower().split(), "END"]
        score = 0.0
        for x, y in zip(["BEGIN", *w], w):
            low = 1 / (v + 1)
            if c2:
                low = (max(after[y] - d1[min(after[y], 3)], 0) + sum(d1[min(k, 3)] for k in after.values()) / (v + 1)) / len(c2)
            f = followers.get(x)
            p = low if not f else (max(c2[x, y] - d2[min(c2[x, y], 3)], 0) + sum(d2[min(k, 3)] for k in f) * low) / sum(f)
            score += math.log10(p)
        yield len(w), sum(c1[y] > 0 for y in w), n, sum(math.log10((c1[y] + 1) / (n + v + 1)) for y in w), score


@pytest.mark.parametrize("slice_text", [lm.SLICE_TEXT, 500])
def test_scores_match_brute_force(spark, monkeypatch, slice_text):
    monkeypatch.setattr(lm, "SLICE_TEXT", slice_text)
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, "w1 UNSEEN w1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    train = [t for i, t in rows if i % 4]
    model = lm.train(docs.where("doc_id % 4 > 0"))
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs, model).collect()}
    for (i, _), want in zip(rows, brute_lm(train, [t for _, t in rows])):
        assert got[i] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("slice_text", [lm.SLICE_TEXT, 500])
def test_scores_of_order_three_match_brute_force(spark, monkeypatch, slice_text):
    monkeypatch.setattr(lm, "SLICE_TEXT", slice_text)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 30), rng.randrange(1, 30))}" for _ in range(rng.choice([0, 1, 2, 40])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    c3 = Counter(g for i, t in rows if i % 4 for g in zip(["B", "B", *t.split()], ["B", *t.split()], [*t.split(), "E"]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)
    d3, d2, d1 = (lm.discounts([sum(k == j for k in c.values()) for j in (1, 2, 3, 4)]) for c in (c3, c2, c1))
    types = len(c1)

    def step(counts, d, context, key, lower):
        of = [n for k, n in counts.items() if k[:-1] == context]
        if not of:
            return lower
        return max(counts[key] - d[min(counts[key], 3)], 0) / sum(of) + sum(d[min(n, 3)] for n in of) / sum(of) * lower

    def log_of(text):
        total, w = 0, text.split()
        for u, v, x in zip(["B", "B", *w], ["B", *w], [*w, "E"]):
            p = max(c1[x] - d1[min(c1[x], 3)], 0) / len(c2) + sum(d1[min(n, 3)] for n in c1.values()) / len(c2) / (types + 1)
            total += np.log10(step(c3, d3, (u, v), (u, v, x), step(c2, d2, (v,), (v, x), p)))
        return total

    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs.where("doc_id % 4 > 0"), order=3)).collect()}
    plain = {r.doc_id: r for r in lm.score(docs, lm.train(docs.where("doc_id % 4 > 0"))).collect()}
    for i, t in rows:
        assert got[i].score == pytest.approx(log_of(t), abs=1e-9)
        assert got[i][:5] == plain[i][:5]


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a", "c c b", "d"])], "doc_id bigint, text string")
    model = lm.train(docs)
    words = ["a", "b", "c", "d", "neverseen"]
    after_a = {r.doc_id: r.score for r in lm.score(spark.createDataFrame([(i, f"a {w}") for i, w in enumerate(words)] + [(9, "a")], "doc_id bigint, text string"), model).collect()}
    ends = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string"), model).collect()}
    a = 10 ** (ends[0] - after_a[9] + after_a[9])     # p(a) p(END | a)
    total = sum(10 ** after_a[i] / (10 ** ends[i] / first) for i, first in zip(range(5), _first(model, words)))
    assert 10 ** after_a[9] / _first(model, ["a"])[0] + total / _first(model, ["a"])[0] == pytest.approx(1.0) and a > 0


def _first(model, words):
    """Probability of each word at the beginning of a text."""
    hashes = common.words_of([w.encode() for w in words]).hashes
    n = model.pair_count(np.full(len(words), lm.BEGIN, dtype=np.uint64), hashes)
    _, sums = model.contexts(np.array([lm.BEGIN], dtype=np.uint64))
    d = np.array(lm.discounts(model.pair_counts))
    return (np.maximum(n - d[np.minimum(n, 3)], 0) + sums[0, 1:] @ d[1:] * model.unigrams(hashes)) / sums[0, 0]


def test_scores_of_odd_rows(odd_docs, no_docs):
    model = lm.train(odd_docs)
    got = lm.score(odd_docs, model).collect()
    assert len(got) == 15 and all(r.score < 0 and r.n_tokens > 0 for r in got)
    assert lm.score(no_docs, model).count() == 0
    nothing = lm.train(no_docs)
    assert {round(r.score, 9) for r in lm.score(odd_docs, nothing).collect()} == {0.0}


# ---------------------------------------------------------------- near duplicates


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for n in (8, 40, 1000):
            for _ in range(40):
                common_part = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
                sets = [np.unique(np.concatenate([common_part, rng.integers(0, 2**64, n - len(common_part), dtype=np.uint64)])) for _ in range(2)]
                j = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
                r = minhash.registers_of(sets)
                e = minhash.estimate(np.array([(r[0] == r[1]).mean()]), np.array([len(sets[0])]), np.array([len(sets[1])]))[0]
                errors.append(e - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def brute_components(rows):
    def words(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, words(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and x and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = []
    for group in range(14):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 20) + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one"), (len(rows) + 3, "ONE")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_across_the_chunks_of_a_bucket(spark, monkeypatch):
    """Texts that are little more than a passage which many longer ones hold: their partners lie in other chunks."""
    monkeypatch.setattr(minhash, "CHUNK", 1)
    rng = np.random.default_rng(5)
    words, docs, classes = [f"p{k}" for k in range(104)], [], []
    for g in (0, 200):
        shared = rng.integers(1, 60_000, minhash.REGISTERS)
        for i in range(40):
            r = shared.copy()
            r[96:] = rng.integers(1, 60_000, 32)
            # the first two are as long as each other, all others too long for them and for one another
            classes.append((g + i, 109 if i < 2 else int(109 * 1.4**i), bytearray(r.astype(np.uint16).tobytes())))
        docs += [(g + i, " ".join([f"g{g}", *words, *(f"t{g + i}w{k}" for k in range(4))])) for i in range(2)]
    # the pair of the second group is dealt to different chunks in every band it shares
    docs, classes = [d for d in docs if d[0] >= 200], [c for c in classes if c[0] >= 200]
    links = minhash._links(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(classes, "rep bigint, n_shingles bigint, registers binary"),
    )
    assert {(r.a, r.b) for r in links.collect()} == {(200, 201)}


def test_every_member_with_a_partner_is_named(spark):
    """Member 3 is like 1 and 2, which are not like each other: the less likely of them has no earlier partner."""
    three = np.arange(minhash.REGISTERS, dtype=np.uint16) + 1
    one, two = three.copy(), three.copy()
    one[64:96] += 1000
    two[96:126] += 1000
    two[32:36] += 1000
    key = int(minhash.band_keys(three[None]).view(np.int64)[0, 0])
    rows = [(key, 0, i, 100, bytearray(r.tobytes())) for i, r in ((1, one), (2, two), (3, three))]
    groups = spark.createDataFrame(rows, "key bigint, part bigint, rep bigint, n_shingles bigint, registers binary")
    assert {x for r in minhash._likeliest(groups).collect() for x in (r.a, r.b)} == {1, 2, 3}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert by_id[3].component_id == by_id[2].component_id == 1 and not by_id[2].kept and by_id[1].kept
    assert by_id[9].component_id == 8 and by_id[12].component_id == 7
    assert all(by_id[i].kept and by_id[i].n_shingles == 0 for i in (4, 5, 6))
    assert all(r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_near_copies_without_ids(spark):
    """Rows without an id link like any other; a component with an id keeps only that id."""
    base = " ".join(f"w{i}" for i in range(40))
    near = base + " extra"
    rows = [(1, base), (None, near), (None, base + " other"), (None, "x " + near), (None, "lonely words here and there"),
            (None, "copy a b c d e f g"), (None, "copy a b c d e f g h")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = [r for r in got if r.doc_id is None and r.component_id == 1]
    assert len(linked) == 3 and not any(r.kept for r in linked)
    rest = [r for r in got if r.doc_id is None and r.component_id is None]
    assert len(rest) == 3 and sum(r.kept for r in rest) == 2
    assert [r.kept for r in got if r.doc_id == 1] == [True]


@pytest.mark.parametrize("task_links", [10**6, 0])
def test_components(spark, task_links):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(7, 7), (3, 2), (None, 5)]
    parent = {x: x for ab in links if None not in ab and ab[0] != ab[1] for x in ab}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df, task_links).collect()}
    assert got == {i: root(i) for i in parent}
    assert connected_components(df.limit(0), task_links).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_leaks(docs, items, window):
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (named := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= named - {None}
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 600])
def test_leaks_match_brute_force(spark, block_bytes):
    rng = random.Random(8)
    word = lambda: f"v{int(rng.paretovariate(0.6)) % 300}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for i in range(25)] + [(25, None), (None, "a b c"), (26, items_text := "q r s t u v w x y z")]
    docs = []
    for i in range(50):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            source = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = source[rng.randrange(3) :]
        docs.append((i, " ".join(w)))
    docs += [(50, None), (51, ""), (52, items_text.upper().replace(" ", "!")), (53, "q r s t u v w x y")]
    got = {
        r.doc_id: (r.n_words, sum(h.last - h.first + 1 for h in r.hits), r["items"])
        for r in decontaminate.find_leaks(
            spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes
        ).collect()
    }
    assert got == brute_leaks(docs, items, decontaminate.WINDOW)


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "ein wort")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(odd_docs, items).collect()}
    assert got[7]["items"] == [1] and got[12]["items"] == [1] and got[1]["items"] == [] and got[7].score == 0.5
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).where("size(hits) > 0").count() == 0


def test_leaks_of_items_without_id(spark):
    """An item without an id hits the documents that hold it, but gives no name."""
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, "nothing here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, item), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, items).collect()}
    assert [(h.first, h.last) for h in got[1].hits] == [(1, 14)] and got[1]["items"] == [5]
    alone = spark.createDataFrame([(None, item)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, alone).collect()}
    assert [(h.first, h.last) for h in got[1].hits] == [(1, 14)] and got[1]["items"] == [] and got[2].hits == []


# ---------------------------------------------------------------- mixing, sharding


def test_mix(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, rng.choice(["s0"] * 6 + ["s1", "s2", None]), rng.randrange(0, 400)) for i in range(600)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = mixing.mix(sized).taken().collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    total = sum(s for _, _, s in rows)
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for source, target in targets.items():
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - target) <= 6 * mixing.BLOCK_WORDS
        assert all(0 <= r.taken <= 2 * r.size for r in mine) and target <= 2 * mine[0].source_size
    pieces = mixing.mix(sized).pieces.collect()
    assert len({p.slot for p in pieces}) * mixing.BLOCK_WORDS >= sum(p.n for p in pieces)
    again = {(r.doc_id, r.taken) for r in mixing.mix(sized.repartition(7)).taken().collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    odd = mixing.mix(mixing.sized_documents(odd_docs)).taken().collect()
    assert len(odd) == 15 and all(r.taken == 0 for r in odd if r.size == 0)
    assert mixing.mix(mixing.sized_documents(no_docs)).taken().count() == 0


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize(("cells", "shards"), [(sharding.CELLS, 24), (16, 5)])
def test_shards_have_the_smallest_capacity(spark, monkeypatch, cells, shards):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rng = random.Random(shards)
    texts = ["x" * rng.randrange(0, 90) + str(rng.randrange(60)) for _ in range(300)] + ["hot" * 30] * 120
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sharding.shard_by_bytes(docs, shards).collect()
    of_text, shard_bytes, slots, first = {}, {}, {}, {}
    for r in got:
        of_text.setdefault(texts[r.doc_id], set()).add(r.shard)
        shard_bytes[r.shard] = shard_bytes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    groups = [texts.count(t) * (len(t) + 8) for t in sorted(first, key=first.get)]
    assert max(shard_bytes.values()) == brute_capacity(groups, shards)


def test_shards_of_odd_rows(odd_docs, no_docs):
    got = sharding.shard_by_bytes(odd_docs, 4).collect()
    assert len(got) == 15 and {r.shard for r in got} <= {0, 1, 2, 3}
    assert all(r.size == 8 and r.text_crc32 is None for r in got if r.doc_id == 5)
    assert sharding.shard_by_bytes(no_docs).count() == 0


# ---------------------------------------------------------------- language


def test_language(spark, odd_docs, no_docs):
    rng = random.Random(4)
    syllables = {"aa": ["ba", "du", "ki"], "bb": ["zö", "schr", "üm"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(4, 200))), lang) for i in range(300) for lang in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(docs, net).where(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = langid.predict(odd_docs, net).collect()
    assert len(odd) == 15 and {r.lang_pred for r in odd if r.doc_id in (4, 5, 6, 10)} == {"und"}
    assert langid.predict(no_docs, net).count() == 0 and langid.train(no_docs) is None
    assert {r.lang_pred for r in langid.predict(odd_docs, None).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6, 10})


def test_gradients():
    rng = np.random.default_rng(3)
    net = langid.ByteNet(["a", "b", "c"])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rows, right = rng.integers(1, 256, (5, 32)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(rows)[np.arange(5), right]).mean()
    found = net._gradients(rows, right)
    for name in ("filters", "shift", "out", "bias", "bytes"):
        spots = np.argwhere(np.abs(found[name]) > 1e-4)[:3]
        for spot in map(tuple, spots):
            net.p[name][spot] += 1e-6
            up = loss()
            net.p[name][spot] -= 2e-6
            down = loss()
            net.p[name][spot] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(found[name][spot], rel=0.02, abs=1e-5)


def test_kept_hash_is_of_the_kept_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(1, LINE), (2, "x " + LINE + " y")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffixes.op4_prefix_free_repeats(spark, str(tmp_path)).collect()}
    assert got[2].kept_sha256 == hashlib.sha256(b"x  y").hexdigest() and got[2].n_removed == len(LINE) and got[2].n_spans == 1


def test_forward_pass_against_plain_loops():
    """The strided, batched forward pass of the byte network equals plain loops over windows, places and filters."""
    from claimspark.llm import langid

    rng = np.random.default_rng(3)
    net = langid.ByteNet(["a", "b", "c"], seed=5)
    net.p["bytes"][0] = rng.standard_normal(langid.DEPTH)        # padding byte as trained nets may have it
    net.p["shift"] = rng.standard_normal(len(net.p["shift"])).astype(np.float32)
    rows = rng.integers(0, 256, (3, 20)).astype(np.uint8)
    rows[1, 15:] = 0
    widths = [w for w, count in langid.WIDTHS.items() for _ in range(count)]
    want = []
    for row in rows:
        padded = [*row.tolist(), *[0] * (net.span - 1)]
        hidden = []
        for f, width in enumerate(widths):
            best = max(
                sum(float(net.p["bytes"][padded[t + j], d]) * float(net.p["filters"][j * langid.DEPTH + d, f])
                    for j in range(width) for d in range(langid.DEPTH))
                for t in range(len(row))
            )
            hidden.append(max(best + float(net.p["shift"][f]), 0.0))
        logits = [sum(h * float(net.p["out"][f, k]) for f, h in enumerate(hidden)) + float(net.p["bias"][k]) for k in range(3)]
        top = max(logits)
        e = [np.exp(x - top) for x in logits]
        want.append([x / sum(e) for x in e])
    assert np.allclose(net.probabilities(rows), np.array(want), atol=1e-5)
