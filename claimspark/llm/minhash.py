"""Near duplicates by HyperMinHash.

A text's set is its distinct runs of five words. The set's hashes fall into buckets; of the smallest
one in each, a register keeps the number of leading zeros and some mantissa bits. Bands of registers
bring candidates together, equal registers estimate the Jaccard similarity less what would be equal
by chance, and what the estimate does not rule out is verified on the full sets.

Texts with equal sets are one class from the start, so copies cost nothing further. Links are found in
two rounds. The first compares members of a band's bucket in chunks and verifies for each only its most
likely partner, which joins nearly all of a group whatever its size. The second compares, over whole
buckets, only members that are still in different components, and verifies where it compares. Whoever found
nobody in the first takes part in the second where a bucket was split, as a partner may lie in another chunk.
So no pair that matters is left out, and neither round makes a row for each pair; a bucket of M members that
nothing joins makes some M * M / 128 rows, one for each member and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import mix, ngram_hashes, slices, table, words_of
from claimspark.llm.components import connected_components
from claimspark.session import materialise

SHINGLE = 5            # words
SIMILARITY = 75        # per cent
REGISTERS = 128
MANTISSA = 10          # bits
ROWS = 4               # registers of a band: a pair at 0.75 is missed once in 200,000 times
CHUNK = 256            # members of a bucket compared in one step
SLACK = 5              # deviations below the limit at which the estimate rules a pair out

_BITS = REGISTERS.bit_length() - 1
_ORDER = np.argsort(np.random.default_rng(17).random((REGISTERS, REGISTERS)), axis=1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle."""
    w = words_of(texts)
    runs = ngram_hashes(w.hashes, SHINGLE)
    sets = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        sets.append(np.unique(runs[a : b - SHINGLE + 1]) if b - a >= SHINGLE else ngram_hashes(w.hashes[a:b], b - a) if b > a else runs[:0])
    return sets


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``REGISTERS`` 16-bit registers for each set that is not empty.

    An empty bucket takes over another's register, the first that is filled in an order of its own,
    so small sets compare as well as large ones.
    """
    low = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BITS)
    out, filled = np.zeros((len(sets), REGISTERS), np.uint64), np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, low)
        some = at < len(s)
        first = s[np.minimum(at, len(s) - 1)]
        filled[i] = some & (first >> np.uint64(64 - _BITS) == np.arange(REGISTERS, dtype=np.uint64))
        out[i] = first << np.uint64(_BITS)
    zeros = (64 - np.frexp(out.astype(np.float64))[1]).clip(0, 63).astype(np.uint64)
    mantissa = (out << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    found = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    missing, turn = ~filled, 0
    result = found.copy()
    while missing.any() and turn < REGISTERS:
        source = _ORDER[:, turn]
        take = missing & filled[:, source]
        result[take] = found[:, source][take]
        missing &= ~take
        turn += 1
    return result


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` registers."""
    parts = registers.astype(np.uint64).reshape(len(registers), -1, ROWS)
    key = np.arange(parts.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return key


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers that two unrelated sets of these sizes have in common.

    A register of a set of ``x`` members a bucket has ``z`` leading zeros with the probability that the
    smallest of ``x`` uniform values lies there; its mantissa agrees one time in 2^MANTISSA.
    """
    z = np.arange(0, 40)
    upper, lower = 2.0**-z, 2.0 ** -(z + 1)

    def spread(size: np.ndarray) -> np.ndarray:
        x = np.maximum(size / REGISTERS, 1.0)[:, None]
        return np.exp(x * np.log1p(-np.minimum(lower, 0.999999))) - np.where(z == 0, 0.0, np.exp(x * np.log1p(-np.minimum(upper, 0.999999))))

    return (spread(n) * spread(m)).sum(axis=1) * 2.0**-MANTISSA


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    by_chance = chance(n, m)
    return (equal - by_chance) / (1 - by_chance)


def least_estimate() -> float:
    """Estimates below this rule a pair out."""
    limit = SIMILARITY / 100
    return limit - SLACK * (limit * (1 - limit) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, registers`` of each row; ``f1, f2`` identify the set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
            some = [i for i, s in enumerate(sets) if len(s)]
            rows: list[bytes | None] = [None] * len(sets)
            if some:
                for i, r in zip(some, registers_of([sets[i] for i in some])):
                    rows[i] = r.tobytes()
            marks = [
                [int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
                for salt in (0x51ED270B, 0xC2B2AE3D27D4EB4F)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 *(pa.array(m, pa.int64()) for m in marks), pa.array(rows, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "registers"],
            )

    out = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, registers binary"
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sketch, out)


def _bands(classes: DataFrame) -> DataFrame:
    """``key, rep``: one row for each band of a class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = band_keys(np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS))
                reps = np.repeat(batch.column("rep").to_numpy(), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "registers").mapInArrow(keys, "key bigint, rep bigint")


class Group:
    """Members of a bucket, or of a part of one, with their registers."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        self.rows = pa.Table.from_batches(rows).sort_by("rep")
        self.reps, self.n = self.rows["rep"].to_numpy(), self.rows["n_shingles"].to_numpy()
        self.registers = np.frombuffer(b"".join(self.rows["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.keys = band_keys(self.registers).view(np.int64)
        self.band = int(np.flatnonzero(self.keys[0] == self.rows["key"][0].as_py())[0])

    def partners(self, i: int, other: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``other`` that neither size nor estimate rules out, and their estimates."""
        n = self.n
        other = other[100 * np.minimum(n[other], n[i]) >= SIMILARITY * np.maximum(n[other], n[i])]
        like = estimate((self.registers[other] == self.registers[i]).mean(axis=1), n[other], np.full(len(other), n[i]))
        return other[like >= least], like[like >= least]

    def apart(self, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each minor member with its possible partners in other components.

        A pair that shares several bands is looked at in the first of them only.
        """
        part = self.rows["component"].to_numpy()
        for i in np.flatnonzero(self.rows["minor"].to_numpy()).tolist():
            other = np.flatnonzero(part != part[i])
            other = other[(self.keys[other] == self.keys[i]).argmax(axis=1) == self.band]
            other, like = self.partners(i, other, least)
            if len(other):
                yield i, other, like


def _in_groups(rows: DataFrame, work: Callable[[Group], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to each ``(key, part)``; a group holds a chunk or two."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column("key").to_numpy(), batch.column("part").to_numpy()], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:]):
                if tuple(keys[s]) != name and held:
                    if (found := work(Group(held))) is not None:
                        yield found
                    held = []
                name = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held and (found := work(Group(held))) is not None:
            yield found

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(scan, schema)


def _likeliest(groups: DataFrame) -> DataFrame:
    """``a, b``: each member of a group with its likeliest earlier partner, or a later one where nothing else names it."""
    least = least_estimate()

    def work(group: Group) -> pa.RecordBatch:
        a, b = [], []
        named = np.zeros(len(group.reps), dtype=bool)
        best, later = np.zeros(len(group.reps)), np.full(len(group.reps), -1)
        for i in range(1, len(group.reps)):
            other, like = group.partners(i, np.arange(i), least)
            if len(other):
                first = other[np.argmax(like)]
                a.append(group.reps[first])
                b.append(group.reps[i])
                named[[first, i]] = True
                better = other[like > best[other]]
                best[other] = np.maximum(best[other], like)
                later[better] = i
        for i in np.flatnonzero(~named & (later >= 0)).tolist():
            a.append(group.reps[i])
            b.append(group.reps[later[i]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _in_groups(groups, work, "a bigint, b bigint").distinct()


def _undecided(groups: DataFrame) -> DataFrame:
    """``key, part, rep``: members with a possible partner in another component."""
    least = least_estimate()

    def work(group: Group) -> pa.RecordBatch:
        some = np.zeros(len(group.reps), dtype=bool)
        for i, other, _ in group.apart(least):
            some[i] = True
            some[other] = True
        return group.rows.select(["key", "part", "rep"]).filter(pa.array(some)).combine_chunks().to_batches()[0] if some.any() else None

    return _in_groups(groups, work, "key bigint, part bigint, rep bigint").distinct()


def _decided(groups: DataFrame) -> DataFrame:
    """``a, b``: verified links between components, one for each minor member and component."""
    least = least_estimate()

    def work(group: Group) -> pa.RecordBatch:
        sets = shingle_sets(group.rows["text"].cast(pa.binary()).to_pylist())
        part, a, b = group.rows["component"].to_numpy(), [], []
        for i, other, like in group.apart(least):
            linked = set()
            for j in other[np.argsort(-like, kind="stable")].tolist():
                if part[j] not in linked and similar(sets[i], sets[j]):
                    linked.add(part[j])
                    a.append(group.reps[i])
                    b.append(group.reps[j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _in_groups(groups, work, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets are as similar as asked."""
    if not len(x) or 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= SIMILARITY * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a"), "text_b"):
            first, second = (shingle_sets(batch.column(c).cast(pa.binary()).to_pylist()) for c in ("text_a", "text_b"))
            linked = pa.array([similar(x, y) for x, y in zip(first, second)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(linked)

    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(check, "a bigint, b bigint")


def _links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links ``a, b`` between classes, enough to tell all components."""
    bands = materialise(_bands(classes), "minhash-bands")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialise(
        bands.join(shared, "key").join(classes.select("rep", "n_shingles", "registers"), "rep"), "minhash-members"
    )
    chunks = F.ceil(F.col("members") / CHUNK)
    likely = materialise(_likeliest(members.withColumn("part", F.pmod(F.xxhash64("rep", "key"), chunks))), "minhash-likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    # whoever has a partner in its chunk is among these; in a bucket of one chunk that is whoever has one at all
    texts = materialise(
        docs.hint("merge").join(ends, F.col("doc_id") == F.col("rep")).select("rep", "text").dropDuplicates(["rep"]), "minhash-texts"
    )
    links = materialise(_verified(likely, texts), "minhash-links")
    known = connected_components(links)

    tried = members.join(ends.withColumn("end", F.lit(True)), "rep", "left").where((F.col("members") > CHUNK) | F.col("end"))
    tried = tried.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    tried = tried.withColumn("component", F.coalesce("component", "rep"))
    sizes = tried.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("key")
        .agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))
        .where("all > most")
    )
    rows = tried.join(mixed, "key").withColumn("minor", F.col("component") != F.col("main"))
    lots, wholes = F.ceil((F.col("all") - F.col("most")) / CHUNK), F.ceil(F.col("all") / CHUNK)
    lot_of, whole_of = F.pmod(F.xxhash64("rep"), lots), F.pmod(F.xxhash64("rep"), wholes)
    # a group is one chunk of the minor members against one chunk of the whole bucket
    asking = rows.where("minor").withColumn("lot", lot_of).withColumn("whole", F.explode(F.sequence(F.lit(0), wholes - 1)))
    others = rows.withColumn("minor", F.lit(False)).withColumn("whole", whole_of).withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1)))
    # where a minor member is in both chunks, it is there once, and asks
    others = others.where(~((F.col("component") != F.col("main")) & (F.col("lot") == lot_of)))
    needed = ["key", "part", "rep", "n_shingles", "registers", "component", "minor"]
    groups = materialise(
        asking.unionByName(others).withColumn("part", F.col("lot") * wholes + F.col("whole")).select(*needed), "minhash-groups"
    )
    named = materialise(_undecided(groups), "minhash-undecided")
    missing = materialise(named.select("rep").distinct().join(texts, "rep", "left_anti"), "minhash-missing")
    more = docs.join(missing, F.col("doc_id") == F.col("rep")).select("rep", "text").dropDuplicates(["rep"])
    texts = texts.unionByName(materialise(more, "minhash-more-texts"))
    undecided = groups.join(named, ["key", "part", "rep"]).join(texts, "rep").select(*needed, "text")
    return links.unionByName(materialise(_decided(undecided).distinct(), "minhash-more"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Texts are linked from 75 % Jaccard similarity of their sets of five-word shingles on, confirmed
    on the full sets. ``component_id`` is the smallest id that links lead to; ``kept`` marks it.
    NULL and empty texts have no set and are linked with nothing. Equal texts, and texts with equal sets, are
    linked however short. Repeated rows of an id are one document: each of them is kept or dropped alike. A
    row with a NULL id takes part under a stand-in id above all ids, drawn from its text (so NULL-id rows with
    equal texts are one document): it links like any other, its ``doc_id`` and a ``component_id`` that is a
    stand-in are NULL again in the result, and it is kept only as the least stand-in of a component without
    any id. Ids must lie below 2^62. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    top = docs.agg(F.max("doc_id")).first()[0]
    top = -1 if top is None else top
    stand_in = F.lit(top + 1) + F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(1 << 62))
    docs = docs.withColumn("doc_id", F.coalesce(F.col("doc_id"), stand_in))
    drawn = materialise(sketches(docs, "doc_id", "text"), "minhash-sketches")
    sets = drawn.where("n_shingles > 0")
    same = ["f1", "f2", "n_shingles"]
    least = materialise(sets.groupBy(*same).agg(F.min("doc_id").alias("rep")), "minhash-classes")
    classes = (
        sets.join(least.where("rep is not null"), same).where("doc_id = rep")
        .select("rep", "n_shingles", "registers").dropDuplicates(["rep"])
    )
    components = connected_components(_links(docs, materialise(classes, "minhash-reps")))
    of_class = least.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        *same, F.coalesce("component", "rep").alias("component_id")
    )
    judged = sets.select("doc_id", *same).join(of_class, same).select("doc_id", "n_shingles", "component_id")
    alone = drawn.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    back = lambda c: F.when(F.col(c) <= top, F.col(c)).alias(c)
    return judged.unionByName(alone).select(
        back("doc_id"), "n_shingles", back("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, (len(w) - 3)::BIGINT), lambda k: array_to_string(w[k : k + 4], ' ')) END) AS g
  FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
