"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's vector is the sum of two rows of one hashed table: one for the word, one for its first letters, so inflected
forms share what is learnt.  Filters of one, two and three words slide over the vectors; each filter's greatest value over
a text feeds a logistic unit.  All of it is trained in numpy by AdaGrad on a bounded, documented sample of labelled
documents (SAMPLE, whole texts).  The score sees the text only.  Its intercept puts the best decision, by F1 on a quarter of the sample
that a first model isn't trained on, at THRESHOLD; thresholds by language are calibrated there, too: decisions() reads the language
column beside a score, not for it.

Edge cases: null and empty texts have no words and get the score of an empty text; repeated rows get equal scores, up to the rounding of
single precision; without
labels of both kinds the score is the constant share of label 1, or 0.5; a language without enough labels of both kinds
has the threshold of all languages.  A null id is in neither fold (held_out is false there) and is scored; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, labelled_sample
from .textops import LOWER, U64, Rolling, flat, mix, ranges, runs, slices, tidied, tuned

#: Labelled documents in the sample, at most; folds of the hold-out; the decision threshold of op1.
SAMPLE, FOLDS, FOLD, THRESHOLD = 5000, 3, 1, 0.7
ROWS, SIZE, FILTERS, WIDTHS, PREFIX = 1 << 16, 8, 12, (1, 2, 3), 5
EPOCHS, BATCH, STEP = 24, 32, 0.15
_WORD = np.zeros(256, bool)
_WORD[97:123] = _WORD[128:] = True


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n words, 2) table rows, bounds by text).  Row 0 is kept for no word."""
    raw, offsets = flat(texts)
    raw = LOWER[raw]
    starts, ends = runs(_WORD[raw])
    rolling = Rolling(raw)
    whole, front = rolling.of(starts, ends), mix(rolling.of(starts, np.minimum(ends, starts + PREFIX)) + U64(1))
    rows = np.stack((whole % U64(ROWS - 1), front % U64(ROWS - 1)), 1).astype(np.int32) + 1
    return rows, np.searchsorted(starts, offsets)


def padded(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with as many empty ones after each text as the widest filter reaches over, and the new bounds.

    Windows begin at a text's words, or at the first empty one behind them: those reach into no other text.
    """
    tail = max(WIDTHS)
    n = np.diff(bounds)
    cut = np.concatenate(([0], np.cumsum(n + tail)))
    out = np.zeros((cut[-1], 2), np.int32)
    out[ranges(cut[:-1], n)] = rows
    return out, cut


class Model:
    """Embeddings, filters and output weights."""

    def __init__(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.embedding = (rng.standard_normal((ROWS, SIZE)) * 0.1).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [(rng.standard_normal((w, SIZE, FILTERS)) * (0.5 / w)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.base = np.float32(np.log(share / (1 - share)))
        if 0 < y.sum() < len(y):
            self._train(texts, y.astype(np.float32), rng)
        else:
            self.out[:] = 0

    def pooled(self, rows: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest filter values by text, and all filter values."""
        x = self.embedding[rows[:, 0]] + self.embedding[rows[:, 1]]
        x = np.concatenate((x, np.zeros((max(WIDTHS), SIZE), np.float32)))
        maps = []
        for f in self.filters:
            value = x[: len(rows)] @ f[0]
            for k in range(1, len(f)):
                value += x[k : len(rows) + k] @ f[k]
            maps.append(value)
        # each text's windows, and between them those that reach into the next text
        spans = np.stack((cut[:-1], cut[1:] - max(WIDTHS) + 1), 1).ravel()
        top = np.concatenate([np.maximum.reduceat(m, spans, axis=0)[::2] for m in maps], 1) if len(cut) > 1 else np.zeros((0, len(self.bias)), np.float32)
        return top, maps

    def score(self, rows: np.ndarray, cut: np.ndarray) -> np.ndarray:
        top, _ = self.pooled(rows, cut)
        return 1 / (1 + np.exp(-(np.tanh(top + self.bias) @ self.out + self.base).astype(np.float64)))

    def _train(self, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
        squares = [np.full_like(p, 1e-3) for p in (self.embedding, *self.filters, self.bias, self.out)]
        base_square = 1e-3
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            rate = STEP * (1 - 0.8 * epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                rows, cut = padded(np.concatenate([texts[i] for i in some]), np.concatenate(([0], np.cumsum([len(texts[i]) for i in some]))))
                top, maps = self.pooled(rows, cut)
                hidden = np.tanh(top + self.bias)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.base)))
                error = (p - y[some]) / len(some)
                back = error[:, None] * self.out * (1 - hidden**2)
                grads = [None, *(np.zeros_like(f) for f in self.filters), back.sum(0), hidden.T @ error]
                moved, change = [], []
                for j, (f, m) in enumerate(zip(self.filters, maps, strict=True)):
                    part = back[:, j * FILTERS : (j + 1) * FILTERS]
                    where = np.stack([a + m[a:b].argmax(0) for a, b in zip(cut[:-1], cut[1:] - max(WIDTHS) + 1, strict=True)])
                    for k in range(len(f)):
                        word = rows[np.minimum(where + k, len(rows) - 1)]
                        vector = self.embedding[word[..., 0]] + self.embedding[word[..., 1]]
                        grads[1 + j][k] = np.einsum("bfs,bf->sf", vector, part)
                        step = part[..., None] * f[k].T
                        for c in (0, 1):
                            moved.append(word[..., c].ravel())
                            change.append(step.reshape(-1, SIZE))
                for param, square, g in zip((*self.filters, self.bias, self.out), squares[1:], grads[1:], strict=True):
                    square += g**2
                    param -= rate * 0.3 * g / np.sqrt(square)
                base_square += error.sum() ** 2
                self.base -= np.float32(rate * 0.3 * error.sum() / np.sqrt(base_square))
                touched, inverse = np.unique(np.concatenate(moved), return_inverse=True)
                g = np.zeros((len(touched), SIZE), np.float32)
                np.add.at(g, inverse, np.concatenate(change))
                g[touched == 0] = 0
                squares[0][touched] += g**2
                self.embedding[touched] -= rate * g / np.sqrt(squares[0][touched])


class Classifier:
    """A model of all rows, with an intercept that puts the best decision at THRESHOLD, and thresholds by language.

    The best decisions are those of a first model on the quarter of the rows that it isn't trained on.
    """

    def __init__(self, rows: list[tuple[int, str, bytes]], shift: float) -> None:
        y = np.array([r[0] for r in rows], float)
        texts = [np.frombuffer(r[2], np.int32).reshape(-1, 2) for r in rows]
        held = np.flatnonzero(np.arange(len(rows)) % 4 == 3)
        self.threshold, self.by_language = THRESHOLD, {}
        self.model = Model(texts, y)
        known = 0 < y.sum() < len(y)
        self.model.base += np.float32(shift if known else 0)
        train = np.setdiff1d(np.arange(len(rows)), held)
        if not (known and 0 < y[held].sum() < len(held) and 0 < y[train].sum() < len(train)):
            return
        first = Model([texts[i] for i in train], y[train])
        first.base += np.float32(shift)
        scores = np.concatenate([first.score(*padded(texts[i], np.array([0, len(texts[i])]))) for i in held])
        language = np.array([rows[i][1] for i in held])
        move = _logit(THRESHOLD) - _logit(_best(scores, y[held], THRESHOLD))
        self.model.base += np.float32(move)
        scores = 1 / (1 + np.exp(-(_logit(scores) + move)))
        for name in np.unique(language):
            of = language == name
            if min(y[held][of].sum(), (1 - y[held][of]).sum()) >= 5:
                self.by_language[str(name)] = _best(scores[of], y[held][of], self.threshold)


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _best(score: np.ndarray, y: np.ndarray, default: float) -> float:
    """The threshold with the best F1, in the middle of its gap."""
    if not 0 < y.sum() < len(y):
        return default
    order = np.argsort(-score)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    below = score[order][i + 1] if i + 1 < len(y) else 0.0
    return float((score[order][i] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str | None = None, most: int = SAMPLE, folds: int = FOLDS, fold: int = FOLD) -> Classifier:
    """docs: with doc_id; labels: doc_id and toxic; lang: the column that thresholds are calibrated by."""
    tuned(docs.sparkSession)
    base = docs.select("doc_id", docs[text].cast("string").alias("text"), (docs[lang].cast("string") if lang else F.lit(None).cast("string")).alias("lang"))
    sample = labelled_sample(base, labels, "toxic", folds, fold, most)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, bounds = word_rows(part.column("text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"), "lang": part.column("lang"), "x": pa.array([rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    rows = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "lang", "text").mapInArrow(tidied(of), "doc_id string, label int, lang string, x binary").collect()
    rows = sorted((r.doc_id, r.label, r.lang or "", bytes(r.x)) for r in rows)
    counts = dict(labels.where(~held_out("doc_id", folds, fold) & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect())
    positive = sum(r[1] for r in rows)
    shift = float(np.log(counts[1] / counts[0]) - np.log(positive / (len(rows) - positive))) if counts.get(0) and counts.get(1) and 0 < positive < len(rows) else 0.0
    return Classifier([r[1:] for r in rows], shift)


def scored(docs: DataFrame, classifier: Classifier, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with the score added."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    tuned(docs.sparkSession)
    at, names, model = docs.columns.index(text), docs.columns, classifier.model
    docs = docs.withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{at}", 1 << 20):
                value = model.score(*padded(*word_rows(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], schema.names)

    return docs.mapInArrow(tidied(score), schema).toDF(*names, into)


def decisions(docs: DataFrame, classifier: Classifier, score: str = "toxicity", lang: str = "lang", into: str = "toxic") -> DataFrame:
    """Whether a score reaches the threshold of the row's language."""
    limit = F.lit(classifier.threshold)
    for name, value in sorted(classifier.by_language.items()):
        limit = F.when(F.col(lang) == name, F.lit(value)).otherwise(limit)
    return docs.withColumn(into, F.col(score) >= limit)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    classifier = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lang="lang")
    out = decisions(scored(docs, classifier, into="score"), classifier, "score", into="toxic_by_language")
    return out.select("doc_id", F.coalesce(held_out("doc_id", FOLDS, FOLD), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_by_language")
