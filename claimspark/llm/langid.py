"""Language of whole texts by a small convolutional network over bytes, trained here in numpy.

Filters of several widths slide over embedded bytes, each filter's largest answer in a window goes
to a softmax layer. A text is cut in windows of a fixed length, all of them, and the mean over the
windows decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import drawn, fold_of, fresh, packed, slices, table

WINDOW = 256           # bytes
DEPTH = 8              # numbers for a byte
WIDTHS = {2: 6, 3: 9, 4: 9}     # filters of each width
BATCH = 256            # windows computed at once
SAMPLE_PER_LANG = 600  # labelled rows that the network is fitted on, for each language
SAMPLE_ROWS = 20_000   # and in all
PARTS = 4              # places of a sampled text that are looked at
EPOCHS = 6
UNKNOWN = "und"


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """The whole text as rows of ``length`` bytes, the last one filled up with zeros."""
    rows = -(-len(text) // length)
    return np.frombuffer(text.ljust(rows * length, b"\0"), dtype=np.uint8).reshape(rows, length)


class ByteNet:
    """Embedding, multi-width filters, max pooling, softmax. ``labels`` are its answers."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng, self.labels, self.span = np.random.default_rng(seed), labels, max(WIDTHS)
        n = sum(WIDTHS.values())
        self.mask = np.zeros((self.span * DEPTH, n), dtype=np.float32)
        first = 0
        for width, count in WIDTHS.items():
            self.mask[: width * DEPTH, first : first + count] = 1
            first += count
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.p = {
            "bytes": draw(256, DEPTH) * 0.5,
            "filters": draw(self.span * DEPTH, n) * self.mask * 0.25,
            "shift": np.zeros(n, dtype=np.float32),
            "out": draw(n, len(labels)) * 0.25,
            "bias": np.zeros(len(labels), dtype=np.float32),
        }
        self.p["bytes"][0] = 0

    def _pool(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest answer of each filter, where it stood, and the stretches of embedded bytes."""
        n, length = rows.shape
        padded = np.zeros((n, length + self.span - 1), dtype=np.uint8)
        padded[:, :length] = rows
        flat = self.p["bytes"][padded].reshape(n, -1)
        step = flat.strides
        wide = np.lib.stride_tricks.as_strided(
            flat, (n, length, self.span * DEPTH), (step[0], DEPTH * step[1], step[1]), writeable=False
        )
        answers = (wide.reshape(n * length, -1) @ self.p["filters"]).reshape(n, length, -1)
        return answers, padded, wide

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        found = []
        for i in range(0, len(rows), BATCH):
            answers, _, _ = self._pool(rows[i : i + BATCH])
            hidden = np.maximum(answers.max(axis=1) + self.p["shift"], 0)
            found.append(_softmax(hidden @ self.p["out"] + self.p["bias"]))
        return np.concatenate(found) if found else np.zeros((0, len(self.labels)), dtype=np.float32)

    def fit(self, rows: np.ndarray, answers: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam on the cross entropy. Half of the windows are cut short, as short texts will be."""
        rng, moments, t = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), 64):
                pick = order[i : i + 64]
                batch = rows[pick].copy()
                keep = np.where(rng.random(len(pick)) < 0.5, batch.shape[1], rng.integers(12, batch.shape[1], len(pick)))
                batch[np.arange(batch.shape[1]) >= keep[:, None]] = 0
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, g in self._gradients(batch, answers[pick]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, rows: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
        answers, padded, wide = self._pool(rows)
        n, _, filters = answers.shape
        at = answers.argmax(axis=1)
        top = np.take_along_axis(answers, at[:, None, :], axis=1)[:, 0] + self.p["shift"]
        hidden = np.maximum(top, 0)
        error = _softmax(hidden @ self.p["out"] + self.p["bias"])
        error[np.arange(n), right] -= 1
        error /= n
        back = (error @ self.p["out"].T) * (top > 0)
        seen = wide[np.arange(n)[:, None], at]                      # n, filters, span * DEPTH
        to_bytes = (back[:, :, None] * self.p["filters"].T).reshape(n, filters, self.span, DEPTH)
        places = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(self.span)]
        embedded = np.zeros_like(self.p["bytes"])
        np.add.at(embedded, places.ravel(), to_bytes.reshape(-1, DEPTH))
        embedded[0] = 0
        return {
            "bytes": embedded,
            "filters": np.einsum("nf,nfk->kf", back, seen) * self.mask,
            "shift": back.sum(axis=0),
            "out": hidden.T @ error,
            "bias": error.sum(axis=0),
        }


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, most: int = SAMPLE_ROWS) -> ByteNet | None:
    """Fit on ``doc_id, text, lang`` rows; NULL text or language is passed over.

    The sample is bounded: ``per_lang`` rows a language and ``most`` in all, chosen by a hash of
    the id, of each ``PARTS`` places of a window's length. None where nothing is labelled.
    """
    usable = labelled.where("text is not null and lang is not null").withColumn("draw", F.xxhash64("doc_id"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))     # a row for each language
    whole = F.length("text")
    starts = [F.greatest(F.lit(1), (whole * k / PARTS).cast("int") + 1) for k in range(PARTS)]
    turn = Window.partitionBy("lang").orderBy("draw", "parts")
    sample = (
        usable.join(F.broadcast(counts), "lang").where(drawn(F.col("doc_id"), per_lang, F.col("rows")))
        .select("lang", "draw", F.array(*[F.substring("text", s, F.lit(WINDOW)) for s in starts]).alias("parts"))
        .withColumn("turn", F.row_number().over(turn))
        .where(F.col("turn") <= per_lang)
        .orderBy("turn", "lang")
        .limit(most)
        .select("lang", "parts")
        .collect()
    )
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return None
    pairs = sorted({(p, r["lang"]) for r in sample for p in r["parts"] if p})
    rows = [np.frombuffer(p.encode()[:WINDOW].ljust(WINDOW, b"\0"), dtype=np.uint8) for p, _ in pairs]
    net = ByteNet(labels)
    if len(labels) > 1 and rows:
        place = {label: i for i, label in enumerate(labels)}
        net.fit(np.array(rows), np.array([place[lang] for _, lang in pairs]))
    return net


def predict(docs: DataFrame, net: ByteNet | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its mean probability to rows with a ``text``.

    NULL text, text without a letter, and any text where nothing was learned: ``und`` with score 0.
    Every window of a long text counts alike. Repeated rows are judged alike, an empty table gives no rows.
    Other columns are carried; those that have the new ``names`` are replaced.
    """
    docs = docs.drop(*names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            known = [net is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            windows = [windows_of(t.encode()) for t, ok in zip(texts, known) if ok]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if windows:
                p = net.probabilities(np.concatenate(windows)).astype(np.float64)
                first = np.cumsum([0, *map(len, windows)])
                means = np.add.reduceat(p, first[:-1], axis=0) / np.diff(first)[:, None]
                best = means.argmax(axis=1)
                for k, i in enumerate(i for i, ok in enumerate(known) if ok):
                    langs[i], scores[i] = net.labels[best[k]], min(1.0, float(means[k, best[k]]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names]
            )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(apply, f"{kept}`{names[0]}` string, `{names[1]}` double")


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, 5) == 0


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more.

    The network is fitted on the labelled rows outside the held-out fold. NULL texts and texts without a letter go.
    Where nothing is labelled no language is told, and every text with a letter stays. All columns are carried
    unchanged, whatever they are called.
    """
    net = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if net is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    doc = fresh(list(docs.columns), "_doc")
    names = (fresh([doc], "_told_lang"), fresh([doc], "_told_score"))
    judged = predict(docs.select(F.col("text"), packed(docs, doc)), net, names)
    kept = judged.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least))
    return kept.select(*[F.col(doc).getField(c).alias(c) for c in docs.columns])


def op10_byte_cnn_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    judged = predict(docs.select("doc_id", "text"), net)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
