"""Benchmark decontamination by an FM-index of each training shard.

A shard is a few megabytes of documents.  Its words become symbols of the test vocabulary; any other word, and the end of
a document, is a separator, so no match can cross one, and stretches of vocabulary words shorter than the shortest test
phrase are left out (they can't match).  The sequence's suffix array (prefix doubling over the groups still tied) gives
its Burrows-Wheeler transform, held as a wavelet matrix.  All distinct test phrases are searched backwards at once: each
step maps both interval ends by a rank at every level.  Rows of non-empty intervals are located by walking to a sampled
suffix position, and the occurrences of a document are merged into removal spans.

Test items are handled in blocks of a bounded number of bytes, which travel with the task; more blocks mean more passes
over the documents, each of which adds to the spans of the one before.  Nothing is shuffled.

Words are found by 64-bit hashes; those of an occurrence are compared byte by byte, and words of items with equal hashes have symbols of
their own, so no result rests on a hash.  Edge cases: a null or empty text has no words; an item with a null id or without words
is no item; items with equal ids count once; an item of fewer than eight words is one phrase; an empty table of either
kind gives rows without hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written
from .textops import LOWER, HashIndex, Rolling, flat, ranges, runs, same_bytes, slices, tidied, tuned

#: Words of a phrase; bytes of test items in one pass; distance of sampled suffix positions.
PHRASE, ITEM_BYTES, SAMPLE = 8, 16 << 20, 4
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lower-cased bytes."""
    starts, ends = runs(_WORD[raw])
    return starts, ends, Rolling(raw).of(starts, ends)


class Phrases:
    """Distinct phrases of some items: symbols (1, 2, ...) by row, lengths, and the items of each."""

    def __init__(self, ids: list[str], texts: list[str], phrase: int) -> None:
        raw, offsets = flat(pa.array(texts, pa.string()))
        raw = LOWER[raw]
        starts, ends, h = words(raw)
        # one word for each hash, and the others that have the hash of one
        self.vocabulary, first, which = np.unique(h, return_index=True, return_inverse=True)
        symbol = which.astype(np.int32) + 1
        self.size_of = (ends - starts)[first]
        self.data = raw[ranges(starts[first], self.size_of)]
        self.begins = np.cumsum(self.size_of) - self.size_of
        apart = np.flatnonzero(~self.spelt(raw, starts, ends, symbol))
        self.crowded, self.others = np.unique(h[apart]), {}
        for i in apart.tolist():
            symbol[i] = self.others.setdefault(raw[starts[i] : ends[i]].tobytes(), len(self.vocabulary) + len(self.others) + 1)
        added = np.frombuffer(b"".join(self.others), np.uint8)
        self.size_of = np.concatenate((self.size_of, np.array([len(x) for x in self.others], np.int64)))
        self.data = np.concatenate((self.data, added))
        self.begins = np.cumsum(self.size_of) - self.size_of
        bounds = np.searchsorted(starts, offsets)
        n = np.diff(bounds)
        count = np.where(n == 0, 0, np.maximum(n - phrase + 1, 1))
        item = np.repeat(np.arange(len(n)), count)
        first = ranges(bounds[:-1], count)
        size = np.minimum(n[item], phrase)
        at = first[:, None] + np.arange(phrase)
        rows = np.where(np.arange(phrase) < size[:, None], symbol[np.minimum(at, max(len(symbol) - 1, 0))], 0) if len(symbol) else np.zeros((0, phrase), np.int32)
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        self.size = (self.rows > 0).sum(1)
        pair = np.unique(np.stack((which.ravel(), item), 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.item_bounds = np.searchsorted(pair[:, 0], np.arange(len(self.rows) + 1))
        self.item = pair[:, 1]
        self.ids = ids

    def spelt(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Whether words of a text are those of their symbols, byte by byte."""
        size = ends - starts
        same = self.size_of[symbol - 1] == size
        same[same] = same_bytes(raw, starts[same], self.data, self.begins[symbol[same] - 1], size[same])
        return same


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a sequence of non-negative symbols whose last is its only -1 (the end)."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.concatenate(([True], s[order[1:]] != s[order[:-1]]))
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    width = 1
    while True:
        tied = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if not len(tied):
            return order
        rows = order[tied]
        key = (rank[rows] << 32) | (rank[np.minimum(rows + width, n - 1)] + 1)
        inner = np.argsort(key, kind="stable")
        rows, key = rows[inner], key[inner]
        order[tied] = rows
        split = np.concatenate(([True], key[1:] != key[:-1]))
        new[tied] = split
        rank[rows] = np.maximum.accumulate(np.where(split, tied, 0))
        width *= 2


class FMIndex:
    """Symbols 0 to high; rank queries over arrays through a wavelet matrix."""

    def __init__(self, s: np.ndarray, high: int, sample: int = SAMPLE) -> None:
        """s: symbols >= 0; an end is added."""
        n = len(s) + 1
        sa = suffix_array(np.concatenate((s.astype(np.int64), [-1])))
        s1 = np.concatenate((s.astype(np.int64) + 1, [0]))  # the end is symbol 0
        self.bwt = s1[sa - 1]
        self.levels = int(high + 1).bit_length()
        counts = np.bincount(s1, minlength=high + 3)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.ones, self.zeros = [], []
        row = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(n - self.ones[-1][-1]))
            row = np.concatenate((row[~bit], row[bit]))
        base = np.zeros(high + 3, np.int64)  # where a symbol's run starts on the last level
        there = np.flatnonzero(counts)
        base[there] = self._down(there, np.zeros(len(there), np.int64))
        self.base = base
        self.marked = sa % sample == 0
        self.marked_rank = np.cumsum(self.marked) - 1
        self.kept = sa[self.marked]

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = self.ones[k][i]
            i = np.where((c >> level) & 1, self.zeros[k] + one, i - one)
        return i

    def before(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The row that symbol c before the first i rows leads to: first[c] plus its rank."""
        return self.first[c] + self._down(c, i) - self.base[c]

    def search(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur; a row of symbols is left-aligned."""
        n = len(self.bwt)
        who, low, high = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        for step in range(rows.shape[1]):
            at = size[who] - 1 - step
            move = at >= 0
            c = rows[who, np.maximum(at, 0)].astype(np.int64) + 1
            low = np.where(move, self.before(c, low), low)
            high = np.where(move, self.before(c, high), high)
            live = low < high
            who, low, high = who[live], low[live], high[live]
        return who, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps = np.empty(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            hit = self.marked[row]
            out[left[hit]] = self.kept[self.marked_rank[row[hit]]] + steps
            left, row = left[~hit], row[~hit]
            row = self.before(self.bwt[row], row)
            steps += 1
        return out


def occurrences(sequence: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of every occurrence in a sequence of symbols with separators 0."""
    shortest = int(phrases.size.min()) if len(phrases.size) else 1
    a, b = runs(sequence > 0)
    take = b - a >= shortest
    a, size = a[take], (b - a)[take]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = ranges(a, size + 1)
    reduced = sequence[np.minimum(place, len(sequence) - 1)].copy()
    reduced[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(reduced, len(phrases.size_of))
    who, low, high = index.search(phrases.rows, phrases.size)
    row = ranges(low, high - low)
    return np.repeat(who, high - low), place[index.locate(row)]


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "contamination", phrase: int = PHRASE, cut: bool = False) -> DataFrame:
    """docs with a struct added: n_words, n_hit (words in occurrences), merged byte spans [start, end) of hit words, and the items' ids, sorted as strings.

    cut: the spans are cut out of the texts by the last pass.
    """
    tuned(docs.sparkSession)
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    at = docs.columns.index(text)
    names = docs.columns
    docs = docs.withColumn(text, F.col(text).cast("string"))
    bench = bench.select(F.col(item).cast("string").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where("id is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id") + 16), F.lit(0))).first()[0]
    passes = int(total // ITEM_BYTES) + 1
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    schema = T.StructType([*plain.fields, T.StructField("found", FOUND)])
    out = docs.toDF(*plain.names).withColumn("found", F.lit(None).cast(FOUND))
    for k in range(passes):
        some = bench.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k) if passes > 1 else bench
        rows = some.select("id", "text").collect()  # ITEM_BYTES, about
        # ids that stand in several rows are one item
        ids = sorted({r.id for r in rows})
        phrases = Phrases([r.id for r in rows], [r.text for r in rows], phrase)
        number = {x: i for i, x in enumerate(ids)}
        phrases.item = np.array([number[x] for x in phrases.ids], np.int64)[phrases.item] if rows else np.zeros(0, np.int64)
        phrases.ids = ids
        out = out.mapInArrow(tidied(_searcher(phrases, at, cut and k == passes - 1)), schema)
        if k < passes - 1:  # a pass's phrases go before the next come
            out = written(out)
    return out.toDF(*names, into)


def _searcher(phrases: Phrases, at: int, cut: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashIndex()
        known.add(phrases.vocabulary)
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                found = _searched(part, part.column(at), phrases, known)
                yield found.set_column(at, found.schema.field(at), _without(found.column(at), found.column(found.num_columns - 1))) if cut else found

    return search


def _covered(n: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n words lie in occurrences."""
    change = np.bincount(first, minlength=n + 1) - np.bincount(first + size, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def _searched(part: pa.RecordBatch, texts: pa.Array, phrases: Phrases, known: HashIndex) -> pa.RecordBatch:
    raw, offsets = flat(texts)
    raw = LOWER[raw]
    starts, ends, h = words(raw)
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    symbol = known.find(h) + 1
    for i in np.flatnonzero(np.isin(h, phrases.crowded)).tolist() if len(phrases.crowded) else ():
        symbol[i] = phrases.others.get(raw[starts[i] : ends[i]].tobytes(), symbol[i])
    # a separator follows each document
    row = np.repeat(np.arange(len(n_words)), n_words)
    sequence = np.zeros(len(h) + len(n_words), np.int32)
    sequence[np.arange(len(h)) + row] = symbol
    which, place = occurrences(sequence, phrases)
    doc = np.searchsorted(bounds[1:] + np.arange(len(n_words)), place, "right")
    word = place - doc
    hit = _covered(len(h), word, phrases.size[which])
    at = np.flatnonzero(hit)
    wrong = at[~phrases.spelt(raw, starts[at], ends[at], symbol[at])]
    if len(wrong):  # a word that isn't in the vocabulary has the hash of one that is
        true = np.searchsorted(wrong, word) == np.searchsorted(wrong, word + phrases.size[which])
        which, word, doc = which[true], word[true], doc[true]
        hit = _covered(len(h), word, phrases.size[which])
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[bounds[1:]] - sums[bounds[:-1]]
    pair = np.unique((doc << 32) | which)
    pair_doc, pair_phrase = pair >> 32, pair & 0xFFFFFFFF
    per = phrases.item_bounds[pair_phrase + 1] - phrases.item_bounds[pair_phrase]
    items = np.unique((np.repeat(pair_doc, per) << 32) | phrases.item[ranges(phrases.item_bounds[pair_phrase], per)])
    cut = np.searchsorted(items >> 32, np.arange(len(n_words) + 1))
    items &= 0xFFFFFFFF
    a, b = runs(hit)
    # runs of hit words may touch across documents
    inner = np.setdiff1d(bounds[1:-1], np.concatenate((a, b)))
    inner = inner[hit[np.minimum(inner, len(hit) - 1)] & (inner > 0)] if len(hit) else inner
    a, b = np.sort(np.concatenate((a, inner))), np.sort(np.concatenate((b, inner)))
    owner = np.searchsorted(bounds, a, "right") - 1
    first = np.searchsorted(owner, np.arange(len(n_words) + 1))
    before = part.column(part.num_columns - 1).to_pylist()
    out = []
    for d in range(len(n_words)):
        spans = [[int(starts[a[i]] - offsets[d]), int(ends[b[i] - 1] - offsets[d])] for i in range(first[d], first[d + 1])]
        ids = [phrases.ids[i] for i in items[cut[d] : cut[d + 1]]]
        hits = int(n_hit[d])
        if before[d]:
            ids = sorted({*ids, *before[d]["items"]})
            if before[d]["spans"]:
                spans = _merged([*spans, *before[d]["spans"]])
                lo = starts[bounds[d] : bounds[d + 1]] - offsets[d]
                hits = int(sum(np.searchsorted(lo, y) - np.searchsorted(lo, x) for x, y in spans))
        out.append({"n_words": int(n_words[d]), "n_hit": hits, "spans": spans, "items": ids})
    found = pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]))
    return pa.RecordBatch.from_arrays([*part.columns[:-1], found], part.schema.names)


def _without(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = texts.to_pylist()
    for i, f in enumerate(found.to_pylist()):
        if f["spans"]:
            raw, kept, to = out[i].encode(), [], 0
            for x, y in f["spans"]:
                kept.append(raw[to:x])
                to = y
            out[i] = b"".join([*kept, raw[to:]]).decode()
    return pa.array(out, pa.string())


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x < out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = F.col("contamination")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (F.size(c["items"]) >= 2).alias("contaminated"))
