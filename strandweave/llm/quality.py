"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles.  Shallow trees (up to four leaves over one feature's bins) are fitted in turn,
feature by feature, to the gradient of the logistic loss; a feature's trees add up to one lookup table.  Then the pairs of
features whose joint bins explain most of what is left get small two-way tables in the same manner.  A score is a sum of
table entries.  The model is fitted on a bounded, documented sample of labelled documents (SAMPLE); it sees texts only.

Edge cases: null and empty texts have all features zero and are scored like any other; repeated rows get equal scores;
without labels of both kinds the model is the constant share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, labelled_sample
from .textops import U64, Rolling, flat, mix, runs, segment_sums, slices, tidied, tuned

#: Labelled documents in the sample, at most; folds of the hold-out; the decision threshold.
SAMPLE, FOLDS, FOLD, THRESHOLD = 12_000, 5, 0, 0.3
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 120, 40, 8, 0.1
FEATURES = ["log_bytes", "upper", "digit", "stop", "comma", "bang", "symbol", "bar", "line", "non_ascii", "word_length", "short_words", "distinct_words", "distinct_triples", "distinct_lines", "odd_ends"]


def _set(*members: int | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for m in members:
        out[m if isinstance(m, int) else list(m)] = True
    return out


_SPACE = _set(range(9, 14), 32)
_LETTER = _set(range(65, 91), range(97, 123), range(128, 256))
_CLASSES = [_set(range(65, 91)), _set(range(48, 58)), _set(46), _set(44), _set(33), _set(35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 126), _set(124), _set(10), _set(range(128, 256))]


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h by owner."""
    key = np.sort((owner.astype(U64) << U64(40)) | (h >> U64(24)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> U64(40)).astype(np.int64), minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row for each text of a slice."""
    raw, offsets = flat(texts)
    n = len(offsets) - 1
    size = np.diff(offsets) - 1
    per_byte = np.maximum(size, 1)
    out = [np.log1p(size)]
    for table in _CLASSES:
        count = segment_sums(table[raw], offsets)
        out.append((count - (1 if table[10] else 0)) / per_byte)
    starts, ends = runs(~_SPACE[raw])
    rolling = Rolling(raw)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    owner = np.repeat(np.arange(n), words)
    length = ends - starts
    h = rolling.of(starts, ends)
    per_word = np.maximum(words, 1)
    out.append(np.bincount(owner, length, n) / per_word)
    out.append(np.bincount(owner, length <= 3, n) / per_word)
    out.append(_distinct(h, owner, n) / per_word)
    if len(h) > 2:
        inside = owner[2:] == owner[:-2]
        triple = mix(h[:-2] * U64(3) + h[1:-1] * U64(5) + h[2:] * U64(7))[inside]
        own = owner[2:][inside]
        out.append(_distinct(triple, own, n) / np.maximum(np.bincount(own, minlength=n), 1))
    else:
        out.append(np.zeros(n))
    feeds = np.flatnonzero(raw == 10)  # the separator ends a text's last line
    begin = np.concatenate(([0], feeds[:-1] + 1))
    solid = feeds > begin
    begin, feeds = begin[solid], feeds[solid]
    line_owner = np.searchsorted(offsets, begin, "right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    out.append(_distinct(rolling.of(begin, feeds), line_owner, n) / lines)
    out.append(np.bincount(owner, ~_LETTER[raw[ends - 1]] & (raw[ends - 1] != 46) & (raw[ends - 1] != 44), n) / per_word if len(ends) else np.zeros(n))
    return np.where(size[:, None] > 0, np.stack(out, 1), 0.0)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Step of each bin of a tree of some leaves, fitted to sums of gradients and weights by bin."""
    cut = [0, len(gradient)]
    g, w = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        left, right = g[m] - g[a], g[b] - g[m]
        value = left**2 / (w[m] - w[a] + 1) + right**2 / (w[b] - w[m] + 1) - (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
        i = int(np.argmax(value))
        return float(value[i]), int(m[i])

    while len(cut) <= leaves:
        best, at = max(gain(a, b) for a, b in zip(cut, cut[1:], strict=False))
        if best <= 1e-9:
            break
        cut = sorted({*cut, at})
    out = np.zeros(len(gradient))
    for a, b in zip(cut, cut[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


class Model:
    """Bin edges, one-way tables and two-way tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.edges, self.coarse, self.tables, self.pairs = [], [], [], []
        if not 0 < y.sum() < len(y):
            return
        quantile = lambda column, k: np.unique(np.quantile(column, np.arange(1, k) / k))
        self.edges = [quantile(c, BINS) for c in x.T]
        self.coarse = [quantile(c, PAIR_BINS) for c in x.T]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        # the rarer label weighs as much as its share of the population, so scores are probabilities
        logit = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-logit))
                k = len(self.tables[j])
                step = RATE * _tree(np.bincount(b, y - p, k), np.bincount(b, p * (1 - p), k), 4)
                self.tables[j] += step
                logit += step[b]
        coarse = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=True)]
        p = 1 / (1 + np.exp(-logit))
        gains = []
        for i, j in combinations(range(len(coarse)), 2):
            k = len(self.coarse[j]) + 1
            cell = coarse[i] * k + coarse[j]
            gains.append((float((np.bincount(cell, y - p) ** 2 / (np.bincount(cell, p * (1 - p)) + 1)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))))
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-logit))
                cell = coarse[i] * table.shape[1] + coarse[j]
                g, w = np.bincount(cell, y - p, table.size).reshape(table.shape), np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                # a shallow tree over two features: two rows of groups, each with leaves of its own
                halves = _tree(g.sum(1), w.sum(1), 2)
                step = np.zeros_like(table)
                for value in np.unique(halves):
                    rows = halves == value
                    step[rows] = RATE * _tree(g[rows].sum(0), w[rows].sum(0), 2)
                table += step
                logit += step.ravel()[cell]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for e, table, c in zip(self.edges, self.tables, x.T, strict=False):
            logit += table[np.searchsorted(e, c, "right")]
        coarse = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=False)]
        for i, j, table in self.pairs:
            logit += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-logit))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = SAMPLE, folds: int = FOLDS, fold: int = FOLD) -> Model:
    """docs: with doc_id; labels: doc_id and quality."""
    tuned(docs.sparkSession)
    base = docs.select("doc_id", docs[text].cast("string").alias("text"))
    sample = labelled_sample(base, labels, "quality", folds, fold, most).select("label", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                yield pa.record_batch({"label": part.column("label"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = sorted((r.label, bytes(r.x)) for r in sample.mapInArrow(tidied(of), "label int, x binary").collect())
    y = np.array([r[0] for r in rows], float)
    x = np.array([np.frombuffer(r[1]) for r in rows]).reshape(-1, len(FEATURES))
    # both labels fill half of a large sample: the base rate is put right afterwards
    model = Model(x, y)
    counts = dict(labels.where(~held_out("doc_id", folds, fold) & F.col("quality").isin(0, 1)).groupBy("quality").count().collect())
    if 0 < y.sum() < len(y) and counts.get(0) and counts.get(1):
        model.base += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "quality") -> DataFrame:
    """docs with the score added."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    tuned(docs.sparkSession)
    at, names = docs.columns.index(text), docs.columns
    docs = docs.withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{at}"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(part.column(at))))], schema.names)

    return docs.mapInArrow(tidied(score), schema).toDF(*names, into)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), into="score")
    return out.select("doc_id", F.coalesce(held_out("doc_id", FOLDS, FOLD), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
