"""Chunk changes, duplicate bills, the policy in force and equal amounts, on planted cases and against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import history, snapshots


def plain_changes(old, new):
    """Plain per-file diff: k-th equal chunk meets k-th; O(n^2) longest increasing run with the same choice of run."""
    out = []
    files = {f for f, _, _ in old} | {f for f, _, _ in new}
    for f in files:
        o = sorted((p, c or "") for g, p, c in old if g == f)
        n = sorted((p, c or "") for g, p, c in new if g == f)
        seen, pos_of = {}, {}
        for p, c in n:
            seen[c] = seen.get(c, 0) + 1
            pos_of[(c, seen[c])] = p
        seen, matched, lone_old = {}, [], []
        for p, c in o:
            seen[c] = seen.get(c, 0) + 1
            if (c, seen[c]) in pos_of:
                matched.append((p, pos_of.pop((c, seen[c])), c))
            else:
                lone_old.append((p, c))
        lone_new = [(p, c) for (c, _), p in pos_of.items()]
        xs = [m[1] for m in matched]
        length = [1] * len(xs)
        for i in range(len(xs)):
            for j in range(i):
                if xs[j] < xs[i]:
                    length[i] = max(length[i], length[j] + 1)
        run = set()
        if xs:
            best = max(length)
            i = min((k for k in range(len(xs)) if length[k] == best), key=lambda k: xs[k])
            while True:
                run.add(i)
                if length[i] == 1:
                    break
                i = min((j for j in range(i) if length[j] == length[i] - 1 and xs[j] < xs[i]), key=lambda j: xs[j])
        import hashlib
        h = lambda c: hashlib.sha256(c.encode()).hexdigest()
        out += [(f, p, q, "kept" if k in run else "moved", h(c)) for k, (p, q, c) in enumerate(matched)]
        old_at = {p: c for p, c in lone_old}
        new_at = {p: c for p, c in lone_new}
        for p in old_at.keys() | new_at.keys():
            if p in old_at and p in new_at:
                out.append((f, p, p, "updated", h(new_at[p])))
            elif p in old_at:
                out.append((f, p, None, "deleted", h(old_at[p])))
            else:
                out.append((f, None, p, "inserted", h(new_at[p])))
    return sorted(out, key=str)


SCHEMA = "file_name string, pos int, chunk string"


def test_moves_inserts_and_repeats(spark):
    old = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("a", 3, "w"), ("b", 0, "p"), ("b", 1, "p"), ("c", 0, "gone"),
           (None, 0, "n1"), ("", 0, "n1"), ("d", 0, "old text"), ("d", 1, None)]
    new = [("a", 0, "y"), ("a", 1, "z"), ("a", 2, "x"), ("a", 3, "w"), ("b", 0, "p"), ("b", 1, "q"), ("b", 2, "p"),
           ("e", 0, "fresh"), (None, 0, "n2"), ("", 0, "n1"), ("d", 0, "new text"), ("d", 1, "")]
    got = snapshots.chunk_changes(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()
    rows = sorted((tuple(r) for r in got), key=str)
    assert rows == plain_changes(old, new)
    by = {(r[0], r[1], r[2]): r[3] for r in rows}
    assert by[("a", 0, 2)] == "moved" and by[("a", 1, 0)] == "kept" and by[("a", 3, 3)] == "kept"
    assert by[("d", 0, 0)] == "updated" and by[("d", 1, 1)] == "kept" and by[("c", 0, None)] == "deleted"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_snapshots(spark, seed):
    rng = random.Random(seed)
    old, new = [], []
    for f in range(12):
        chunks = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
        old += [(f"f{f}", i, c) for i, c in enumerate(chunks)]
        changed = chunks[:]
        rng.shuffle(changed) if rng.random() < 0.5 else None
        changed = [c if rng.random() < 0.8 else rng.choice("xyz") for c in changed][: rng.randint(0, 10)]
        new += [(f"f{f}", i, c) for i, c in enumerate(changed)]
    got = snapshots.chunk_changes(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_changes(old, new)


def test_no_chunks(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert snapshots.chunk_changes(empty, empty).collect() == []


def test_longest_run():
    assert snapshots.longest_run([2, 0, 1, 3]) == {1, 2, 3}
    assert snapshots.longest_run([]) == set()


LINES = "bill long, section string, part long, qty double, disc double"


def test_duplicate_bills(spark):
    lines = [
        (1, "A", 10, 5.0, 0.05), (1, "N", 11, 2.0, 0.0),
        (2, "N", 11, 2.0, 0.0), (2, "A", 10, 5.9, 0.05),     # same bill as 1, lines in another order
        (3, "A", 10, 5.0, 0.05), (3, "N", 12, 1.0, 0.0),     # shares section A with 1
        (4, "A", 99, 1.0, 0.0), (4, None, 98, 1.0, 0.0),
        (5, "A", 10, 5.0, 0.05), (5, "N", 11, 2.0, 0.0),     # no date: after all others
    ]
    # one hot section that most bills share
    lines += [(100 + i, "R", 7, 1.0, 0.0) for i in range(300)]
    df = spark.createDataFrame(lines, LINES)
    line = F.concat_ws("|", F.col("part").cast("string"), F.floor("qty").cast("bigint").cast("string"),
                       F.round(F.col("disc") * 100).cast("bigint").cast("string"))
    sections, bills = history.hash_tree(df, "bill", "section", line)
    dates = spark.createDataFrame([(b, dt.datetime(2020, 1, 1) + dt.timedelta(days=b % 50)) for b in [1, 2, 3, 4, *range(100, 400)]],
                                  "bill long, d timestamp")
    got = {r.bill: r for r in history.duplicate_bills(sections, bills, dates, "d").collect()}
    assert got[2].duplicate and got[2].first_bill == 1 and not got[1].duplicate
    assert got[5].duplicate and got[5].first_bill == 1
    assert got[3].n_shared_sections == 1 and not got[3].duplicate
    assert got[4].n_sections == 2 and got[4].n_shared_sections == 0
    hot = [got[b] for b in range(100, 400)]
    assert sum(not r.duplicate for r in hot) == 1 and all(r.first_bill == 100 for r in hot)


def test_version_in_force(spark):
    versions = [("P", 1, dt.date(2020, 1, 10)), ("P", 2, dt.date(2020, 3, 1)), ("P", 3, dt.date(2020, 3, 1)),
                ("Q", 1, dt.date(2019, 6, 30)), (None, 9, dt.date(2000, 1, 1))]
    claims = [(1, "P", "2020-01-09"), (2, "P", "2020-01-10"), (3, "P", "2020-02-29"), (4, "P", "2020-03-01"),
              (5, "P", "2021-12-31"), (6, "Q", "2020-01-01"), (7, None, "2020-01-01"), (8, "P", None), (9, "R", "2020-01-01")]
    claims += [(100 + i, "P", str(dt.date(2020, 1, 1) + dt.timedelta(days=i % 400))) for i in range(2000)]
    v = spark.createDataFrame(versions, "policy string, version int, at date")
    c = spark.createDataFrame(claims, "claim long, policy string, day string")
    got = {r.claim: (r.version, r.activated) for r in history.version_in_force(c, v, "policy", "day", "at", "version").collect()}
    assert got[1] == (None, None) and got[2] == (1, dt.date(2020, 1, 10)) and got[3][0] == 1
    assert got[4] == (3, dt.date(2020, 3, 1)) and got[5][0] == 3 and got[6] == (1, dt.date(2019, 6, 30))
    assert got[7] == (None, None) and got[8] == (None, None) and got[9] == (None, None)
    for i in range(2000):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=i % 400)
        want = [(at, n) for _, n, at in versions[:3] if at <= day]
        assert got[100 + i][0] == (max(want)[1] if want else None)


def test_shared_amounts(spark):
    rows = [(1, "P", 10.0), (2, "Q", 10.0), (3, "P", 10.0), (4, "P", 20.0), (5, "P", 20.0), (6, None, 10.0), (7, "R", None)]
    df = spark.createDataFrame(rows, "claim long, policy string, amount double")
    got = [tuple(r) for r in history.shared_amounts(df, "amount", "policy", "claim").collect()]
    assert got == [(10.0, 3, 2, 1)]


def test_check_digits():
    from claimspark.operators import redact

    assert redact.luhn_ok("4539578763621486") and not redact.luhn_ok("4539578763621487")
    # every single changed digit and every swap of neighbours is caught by Verhoeff
    base = "234123412346"
    ok = [d for d in "0123456789" if redact.verhoeff_ok(base[:-1] + d)]
    assert len(ok) == 1
    good = base[:-1] + ok[0]
    assert all(not redact.verhoeff_ok(good[:i] + d + good[i + 1:]) for i in range(12) for d in "0123456789" if d != good[i])
    assert all(not redact.verhoeff_ok(good[:i] + good[i + 1] + good[i] + good[i + 2:]) for i in range(11) if good[i] != good[i + 1])


def test_redaction_overlaps_and_pseudonyms(spark):
    from claimspark.operators import redact

    card = "4539 5787 6362 1486"
    text = (f"mail a.b-7@x.example.com or call +91 98765 43210; card {card}; not a card 4539578763621487; "
            f"ip 10.0.0.255 but 300.1.1.1 no; AUTO-TN-000000123 next to key 0123456789abcdef0123456789abcdef.")
    out, finds = redact.redact_text(text)
    kinds = [f[0] for f in finds]
    assert kinds == ["EMAIL", "PHONE", "CARD", "IPV4", "POLICY", "SECRET"]
    for kind, start, end, name in finds:
        assert name == redact.pseudonym(kind, text[start:end], redact.DEFAULT_KEY)
    assert text[finds[2][1]:finds[2][2]] == card and "4539578763621487" in out
    # leftmost-longest: an address whose local part is an IP-like run is one e-mail
    _, f2 = redact.redact_text("1.2.3.4@host.example.org")
    assert [f[0] for f in f2] == ["EMAIL"]
    # adjacent finds stay apart
    _, f3 = redact.redact_text("10.0.0.1 10.0.0.2")
    assert [(f[1], f[2]) for f in f3] == [(0, 8), (9, 17)]
    df = spark.createDataFrame([(1, text), (2, "again " + card), (3, None), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in df.select("doc_id", redact.redacted(F.col("text")).alias("r")).collect()}
    assert rows[1].r.redacted == out and rows[3].r.redacted is None and rows[4].r.finds == []
    assert rows[2].r.finds[0].pseudonym == finds[2][3]
    assert redact.pseudonym("CARD", card, "another key") != finds[2][3]


def test_duplicate_bills_against_plain_loops(spark):
    """NULL and repeated keys: bills without a key, bills with several dates, equal sections under other names."""
    rng = random.Random(8)
    lines = [(rng.choice([None, *range(40)]), rng.choice(["A", "N", None]), rng.choice(["x", "y", None])) for _ in range(70)]
    lines += [(None, "solo", "only here"), (77, "solo", "only here"), (78, "R", "only here")]
    dates = [(rng.randrange(40), rng.choice([None, *(dt.datetime(2020, 1, d) for d in (1, 2, 3))])) for _ in range(50)]
    sections, bills = history.hash_tree(spark.createDataFrame(lines, "b long, s string, t string"), "b", "s", F.col("t"))
    got = history.duplicate_bills(sections, bills, spark.createDataFrame(dates, "bill long, d timestamp"), "d").collect()

    far = dt.datetime(9999, 12, 31)
    held = {}
    for bill, section, text in lines:
        held.setdefault(bill, {}).setdefault(section or "", []).append(text or "")
    held = {b: {s: tuple(sorted(t)) for s, t in parts.items()} for b, parts in held.items()}
    days = {b: [d or far for k, d in dates if k == b and b is not None] or [far] for b in held}
    rank = lambda pair: (pair[0], pair[1] is not None, pair[1] or 0)
    first_bill, first_section = {}, {}
    for b, parts in held.items():
        for firsts, things in ((first_bill, [tuple(sorted(parts.items()))]), (first_section, parts.values())):
            for x in things:
                firsts[x] = min([firsts[x], (min(days[b]), b)] if x in firsts else [(min(days[b]), b)], key=rank)
    expected = []
    for b, parts in held.items():
        first = first_bill[tuple(sorted(parts.items()))][1]
        others = [first_section[x][1] for x in parts.values()]
        shared = 0 if b is None else len(days[b]) * sum(o is not None and o != b for o in others)
        duplicate = None if b is None or first is None else first != b
        expected += [(b, sum(map(len, parts.values())), len(parts), first, duplicate, shared)] * len(days[b])
    found = [(r.bill, r.n_lines, r.n_sections, r.first_bill, r.duplicate, r.n_shared_sections) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert any(r[5] for r in expected) and any(r[3] is None and r[0] is not None or r[0] is None for r in expected)


def test_hash_tree_sends_texts_not_hashes(spark):
    """The lines travel once, as their short texts."""
    sections, bills = history.hash_tree(spark.createDataFrame([(1, "A", "x")], "b long, s string, t string"), "b", "s", F.col("t"))
    for df in (sections, bills):
        above, below = df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
        assert "sha2(" in above and "sha2(" not in below
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
