"""The pipeline and each of its stages, against what the operators' brute force says."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from claimspark.llm import decontaminate
from claimspark.session import materialise

from .test_texts import brute_components, brute_leaks

WORDS = {"xx": ["kalo", "miru", "tesa", "pono"], "yy": ["strax", "gwend", "ploft", "zwick"]}


def corpus(spark, tmp_path, extra=()):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(220):
        lang = rng.choice(["xx", "yy"])
        text = " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(50)) for _ in range(rng.randrange(20, 90)))
        rows.append((i, text, lang, rng.choice(["s0", "s0", "s1", None]), len(text)))
    rows += [(220 + i, rows[i][1] + " " + rows[i][1].split()[0], rows[i][2], "s1", 1) for i in range(20)]
    item = " ".join(f"bench{j}" for j in range(12))
    rows += [(300 + i, f"{rows[i][1]} {item}", rows[i][2], "s1", 1) for i in range(5, 9)]
    rows += [(400, None, "xx", "s0", 0), (401, "", "yy", "s0", 0), (402, "123 !!", "yy", "s0", 0)]
    docs = spark.createDataFrame([*rows, *extra], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "never seen at all")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return item


def test_stages(spark, tmp_path):
    item = corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, at = docs.columns, {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, str(tmp_path)), "stage")
        at[name] = docs
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == before.dtypes
    told = {r.doc_id for r in at["language"].collect()}
    assert told.isdisjoint({400, 401, 402}) and len(told) >= 243
    rows = [(r.doc_id, r.text) for r in at["language"].collect()]
    alone = {r.doc_id for r in at["near_duplicates"].collect()}
    assert alone == {i for i, (_, _, kept) in brute_components(rows).items() if kept}
    rows = [(r.doc_id, r.text) for r in at["near_duplicates"].collect()]
    clean = {r.doc_id for r in at["decontamination"].collect()}
    assert clean == {i for i, (_, hit, _) in brute_leaks(rows, [(1, item), (2, "never seen at all")], decontaminate.WINDOW).items() if not hit}
    assert any(i >= 300 for i in alone - clean)
    mixed = at["mixing"].collect()
    size = {r.doc_id: len(r.text.split()) for r in at["decontamination"].collect()}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(t <= 2 * size[i] for i, t in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 400
    shards = at["sharding"].collect()
    assert sorted(r.doc_id for r in shards) == sorted(r.doc_id for r in mixed)
    assert sorted(cp.run(spark, str(tmp_path)).select("doc_id", "size", "shard", "slot").collect()) == sorted(
        at["sharding"].select("doc_id", "size", "shard", "slot").collect()
    )


def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    corpus(spark, tmp_path)
    for name, stage in cp.STAGES:
        got = stage(spark, odd_docs, str(tmp_path)).collect()
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
        ids = [r.doc_id for r in got]
        if name == "near_duplicates":
            assert sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 8, 10, 11] and ids.count(None) == 2
        if name == "decontamination":
            assert len(ids) == 15
        if name == "mixing":
            assert set(ids) <= {r.doc_id for r in odd_docs.collect()} and max(ids.count(i) for i in ids) <= 2


def test_stages_carry_clashing_names(spark, tmp_path):
    """Columns named like the stages' own keep their values; rows of one id are chosen by content."""
    from pyspark.sql import functions as F

    corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clash = ["_key", "_row", "_pass", "_n", "_whole", "_first", "_told_score", "_told_lang", "_doc", "_text"]
    odd = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clash])
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns
        for r in got.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in clash)
        odd = materialise(got, "stage")


def test_rows_of_one_id_and_line_breaks(spark, tmp_path):
    from claimspark.llm import mixing

    corpus(spark, tmp_path)
    rows = [(7, "b second row", "s0"), (7, "a first row", "s0"), (8, "line one\nline two\n\nline three four", "s1")]
    df = spark.createDataFrame(rows * 3, "doc_id bigint, text string, source string")
    got = cp.drop_near_duplicates(spark, df, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(7, "a first row"), (8, rows[2][1])]
    many = spark.createDataFrame([(i, "w " * 30 + f"end{i}\nnext line {i}", f"s{i % 3}") for i in range(60)] + rows,
                                 "doc_id bigint, text string, source string")
    taken = mixing.take_mix(many, F.col("doc_id")).collect()
    assert {r.text for r in taken if r.doc_id == 7} <= {"a first row", "a first", "first row", "a", "first", "row"}
    for r in taken:
        whole = next(t for i, t, _ in [*rows, *[(i, "w " * 30 + f"end{i}\nnext line {i}", "") for i in range(60)]] if i == r.doc_id and (i != 7 or t.startswith("a")))
        assert r.text in whole and r.text == r.text.strip()
