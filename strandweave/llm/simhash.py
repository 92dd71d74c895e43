"""SimHash near-duplicate grouping with bit-sliced comparison.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles.  Fingerprints within a radius are linked, and
components of links are the groups.  Distinct fingerprints meet in blocks.  There they are stored as vertical bit planes, 64 to a machine
word; a query is compared with 64 of them at once, carry-save counters add up differing bits, and a word is abandoned as soon as all of
its lanes exceed the radius.

near_duplicates() links 64-bit fingerprints within a radius of two bits at most and loses no link: 64 bits fall into radius + 3 bands,
two fingerprints within the radius agree on at least three whole bands, and each triple of bands is a blocking key.  A block of many
fingerprints is split again by triples of other bands, in its task.

representatives() finds near copies, texts whose five-word shingles have a similarity of 0.8 at least: two bits of 64 are too few for that.
It compares 256-bit fingerprints within the distance that such texts have, and its keys are samples of their bits, as many as it takes for
near copies at that distance to meet with a probability of MEET under one of them at least.  The size of a sample grows with the logarithm
of the table, so that blocks of unlike texts stay small at any size, and the number of samples with it.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows keep a row each (representatives: are
one document); null ids are kept and never serve as component ids unless a component has no other (representatives: aren't looked at).
Other columns of docs aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .components import components
from .textops import LOWER, U64, flat, mix, runs, slices, tidied, tuned

#: Fixed values of the fingerprint's definition.
SEED, SHINGLE, RADIUS = 42, 3, 2
_LANES = U64(0x0001000100010001)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PAIRS_AT_ONCE, TEXT_BYTES = 1 << 16, 1 << 20
#: Rows from which a block is split again; words of a wide fingerprint; the probability that near copies meet; documents of a block of unlike texts.
SPLIT, WIDE, MEET, CROWD = 4096, 4, 0.95, 4
#: A fingerprint of more than a thousandth of all documents is joined by itself: there are no more than that many.
HOT = 1000


def _majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By segment, bit i is set if it is set in over half the values; counted in four 16-bit lanes a word."""
    n = np.diff(bounds)
    out = np.zeros(len(n), U64)
    # a lane holds 65,535 at most, so longer segments are counted in parts
    parts = [np.arange(a, b, 60_000) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
    if not parts:
        return out
    owner = np.repeat(np.flatnonzero(n > 0), [len(p) for p in parts])
    cut = np.concatenate(parts)
    for i in range(16):
        lanes = np.add.reduceat((h >> U64(i)) & _LANES, cut)
        for j in range(4):
            count = np.bincount(owner, ((lanes >> U64(16 * j)) & U64(0xFFFF)).astype(np.float64), minlength=len(n))
            out |= (2 * count > n).astype(U64) << U64(16 * j + i)
    return out


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 values of the shingles of one slice of texts, bounds by text)."""
    raw, offsets = flat(texts)
    raw = LOWER[raw]
    starts, ends = runs(~_SPACE[raw])
    length = ends - starts
    # the words again, single spaces between them and a space between texts
    to = np.concatenate(([0], np.cumsum(length + 1)))
    keep = np.ones(len(raw), bool)
    keep[_SPACE[raw]] = False
    keep[ends] = True  # the byte after a word is white space
    words = np.where(_SPACE[raw], np.uint8(32), raw)[keep].tobytes()
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    index = np.repeat(first[:-1], n_shingles) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], n_shingles)
    last = np.minimum(index + shingle - 1, np.repeat(first[1:], n_shingles) - 1)
    begin, end = to[index].tolist(), (to[last] + length[last]).tolist() if len(index) else []
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(words[a:b], seed) for a, b in zip(begin, end, strict=True)), U64, len(begin)), bounds


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints of one slice of texts."""
    return _majority(*shingle_hashes(texts, shingle, seed))


def wide_fingerprints(texts: pa.Array, shingle: int, words: int = WIDE) -> np.ndarray:
    """The same of several words: (n, words)."""
    h, bounds = shingle_hashes(texts, shingle)
    return np.stack([_majority(mix(h + U64(j * 0x9E3779B97F4A7C15 & 2**64 - 1)), bounds) for j in range(words)], 1)


class _Counters:
    """Counts of 64 lanes a word in bit planes; they start so that a lane's count overflows when it exceeds the radius."""

    def __init__(self, radius: int, n: int) -> None:
        self.planes = [np.full(n, ~U64(0) if ((1 << radius.bit_length()) - 1 - radius) >> k & 1 else U64(0)) for k in range(radius.bit_length())]
        self.waiting: list[np.ndarray | None] = [None] * len(self.planes)
        self.over = np.zeros(n, U64)

    def add(self, x: np.ndarray, level: int = 0) -> None:
        """Adds a bit of each lane: two of a level are added to its plane at once, and their carry is a bit of the next."""
        while True:
            if level == len(self.planes):
                self.over |= x
                return
            y = self.waiting[level]
            if y is None:
                self.waiting[level] = x
                return
            self.waiting[level] = None
            plane = self.planes[level]
            half = plane ^ y
            x, self.planes[level] = (plane & y) | (half & x), half ^ x
            level += 1

    def settle(self) -> np.ndarray:
        """Lanes beyond the radius, nothing waiting."""
        for level in range(len(self.planes)):
            if self.waiting[level] is not None:
                x, self.waiting[level] = self.waiting[level], None
                carry = self.planes[level] & x
                self.planes[level] = self.planes[level] ^ x
                self.add(carry, level + 1)
        return self.over

    def keep(self, live: np.ndarray) -> None:
        self.planes = [p[live] for p in self.planes]
        self.over = self.over[live]


def _links(fp: np.ndarray, run: np.ndarray, radius: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (i < j) in one run whose fingerprints differ in radius bits at most.

    fp: (n,) or (n, words), grouped by run; asked: which rows look for the rows after them (all, if it isn't given).
    """
    fp = fp.reshape(len(fp), -1)
    n, n_words = len(fp), -(-len(fp) // 64)
    bits = np.zeros((fp.shape[1] * 64, n_words * 64), np.uint8)
    for b in range(fp.shape[1] * 64):
        bits[b, :n] = (fp[:, b // 64] >> U64(b % 64)).astype(np.uint8) & 1
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    del bits
    size = np.bincount(run)
    end = np.repeat(np.cumsum(size)[size > 0], size[size > 0])  # of each row's run
    asks = np.arange(n)[end - np.arange(n) > 1] if asked is None else np.flatnonzero(asked & (end - np.arange(n) > 1))
    first, last = (asks + 1) // 64, (end[asks] - 1) // 64
    cuts = np.cumsum(last - first + 1)
    found_i, found_j, at = [], [], 0
    while at < len(asks):
        to = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        count = last[at:to] - first[at:to] + 1
        query = np.repeat(asks[at:to], count)
        w = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at:to], count)
        counters = _Counters(radius, len(w))
        # lanes of the query itself and before it, and of other runs
        low, high = np.clip(query + 1 - 64 * w, 0, 63).astype(U64), np.clip(end[query] - 64 * w, 0, 64)
        counters.over |= (U64(1) << low) - U64(1)
        counters.over |= np.where(high < 64, ~U64(0) << np.minimum(high, 63).astype(U64), U64(0))
        for b in range(len(planes)):
            counters.add(planes[b][w] ^ (U64(0) - ((fp[query, b // 64] >> U64(b % 64)) & U64(1))))
            if b % 16 == 15:
                live = counters.settle() != ~U64(0)
                if not live.all():
                    query, w = query[live], w[live]
                    counters.keep(live)
                if not len(w):
                    break
        if len(w):
            hit = ~counters.settle()
            rows = np.flatnonzero(hit)
            lanes = np.unpackbits(hit[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(lanes)
            found_i.append(query[rows[r]])
            found_j.append(64 * w[rows[r]] + c)
        at = to
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _crowded(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what one large run's links connect.

    What is near the first row is connected by it and isn't compared with itself any more; 64-bit fingerprints of the rest, and
    their pairs with those, meet under keys of other bands.
    """
    fp = fp.reshape(len(fp), -1)
    near = np.bitwise_count(fp ^ fp[0]).sum(1) <= radius
    i, j = [np.zeros(near.sum() - 1, np.int64)], [np.flatnonzero(near)[1:]]
    order = np.concatenate((np.flatnonzero(~near), np.flatnonzero(near)))
    asked = ~near[order]
    if fp.shape[1] > 1 or radius > RADIUS:
        found = [(order, *_links(fp[order], np.zeros(len(fp), np.int64), radius, asked))]
    else:
        found = []
        for mask in _keys(radius, True):
            key = fp[order, 0] & U64(mask)
            sort = np.argsort(key, kind="stable")
            run = np.cumsum(np.concatenate(([0], key[sort][1:] != key[sort][:-1])))
            found.append((order[sort], *_links(fp[order[sort]], run, radius, asked[sort])))
    for own, a, b in found:
        i.append(own[a])
        j.append(own[b])
    return np.concatenate(i), np.concatenate(j)


def linked_rows(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, least position that it is connected to) of the rows that links in their runs connect to an earlier one."""
    size = np.bincount(run)
    some = (size[run] > 1) & (size[run] <= SPLIT)
    rows = np.flatnonzero(some)
    i, j = _links(fp[rows], np.unique(run[rows], return_inverse=True)[1], radius) if len(rows) else (rows, rows)
    i, j = [rows[i]], [rows[j]]
    for k in np.flatnonzero(size > SPLIT):
        own = np.flatnonzero(run == k)
        a, b = _crowded(fp[own], radius)
        i.append(own[a])
        j.append(own[b])
    root = _forest(len(fp), np.concatenate(i), np.concatenate(j))
    other = np.flatnonzero(root != np.arange(len(fp)))
    return other, root[other]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least position reachable from each position by links (i, j)."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        more = label[i] != label[j]
        i, j = i[more], j[more]
    return label


def _keys(radius: int, dealt: bool = False) -> list[int]:
    """Masks of the band triples; each pair within the radius agrees under at least one.  dealt: bit b belongs to band b modulo their number."""
    bands = radius + 3
    if dealt:
        masks = [sum(1 << b for b in range(k, 64, bands)) for k in range(bands)]
    else:
        cuts = [64 * b // bands for b in range(bands + 1)]
        masks = [((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in range(bands)]
    return [sum(masks[b] for b in triple) for triple in combinations(range(bands), 3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _compared(keyed: DataFrame, keys: list[str], words: list[str], vertex: str, radius: int) -> DataFrame:
    """keyed (longs), sorted by keys within partitions, to links (a, b) between vertices: a spanning forest of the links in each block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
            i, j = linked_rows(np.ascontiguousarray(rows[:, len(keys) : len(keys) + len(words)]).view(U64), run, radius)
            return pa.record_batch({"a": rows[i, -1], "b": rows[j, -1]})

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in (*keys, *words, vertex)], 1)
            held.append(rows)
            if (held[0][-1, : len(keys)] == rows[-1, : len(keys)]).all() and (len(held) > 1 or (rows[0, : len(keys)] == rows[-1, : len(keys)]).all()):
                continue  # the block goes on
            rows = np.concatenate(held)
            run = np.concatenate(([0], np.cumsum((rows[1:, : len(keys)] != rows[:-1, : len(keys)]).any(1))))
            cut = int(np.searchsorted(run, run[-1]))
            if cut:
                yield out(rows[:cut], run[:cut])
            held = [rows[cut:].copy()]
        if held:
            rows = np.concatenate(held)
            yield out(rows, np.concatenate(([0], np.cumsum((rows[1:, : len(keys)] != rows[:-1, : len(keys)]).any(1)))))

    return keyed.select(*keys, *words, vertex).mapInArrow(tidied(compare), "a long, b long")


def linked(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (fp long, distinct) to links (a, b).  A block holds fingerprints that agree in three bands of five."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("blocking by triples of bands is for a radius of two bits at most")
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in _keys(radius)])
    keyed = prints.select("fp", F.col("fp").alias("v"), F.posexplode(masks).alias("c", "k"))
    return _compared(keyed.repartition("c", "k").sortWithinPartitions("c", "k", "fp"), ["c", "k"], ["fp"], "v", radius)


def fingerprint_table(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    tuned(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                yield pa.record_batch([part.column("id"), pa.array(fingerprints(part.column("text")).view(np.int64))], ["id", "fp"])

    return docs.select(docs[id_].cast("long").alias("id"), docs[text].cast("string").alias("text")).mapInArrow(tidied(prints), "id long, fp long")


def near_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest id reachable over links."""
    table = written(fingerprint_table(docs, text, id_))
    prints = written(table.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    roots = components(linked(prints.select("fp"), radius))
    roots = roots.join(prints, roots.v == prints.fp).select("fp", "first", "root")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    label = roots.join(least, "root").select("fp", "component_id")
    label = written(prints.join(label, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    # rows of a hot fingerprint stay where they are
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = label.where(F.col("n") > total / HOT).select("fp", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot"))
    rows = table.join(F.broadcast(hot), "fp", "left")
    most = rows.where("_is_hot").select(F.col("id").alias("doc_id"), "fp", F.col("_hot").alias("component_id"))
    rest = rows.where("_is_hot is null").select("id", "fp").join(label.where(F.col("n") <= total / HOT).drop("n"), "fp")
    return most.union(rest.select(F.col("id").alias("doc_id"), "fp", "component_id"))


def distance_of(similarity: float) -> float:
    """Expected share of differing bits of fingerprints of two texts with this Jaccard similarity of shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def samples_of(documents: int, share: float, words: int = WIDE, meet: float = MEET) -> list[list[int]]:
    """Masks (a list of words each) of bit samples, of so many bits that CROWD unlike texts share a key, and so many that texts which differ in a share of the bits meet."""
    bits = max(16, math.ceil(math.log2(max(documents, 1) / CROWD)))
    count = math.ceil(math.log(1 - meet) / math.log(1 - (1 - share) ** bits))
    rng = np.random.default_rng(17)
    out = []
    for _ in range(count):
        chosen = rng.choice(64 * words, min(bits, 64 * words), replace=False).tolist()
        out.append([sum(1 << b % 64 for b in chosen if b // 64 == j) for j in range(words)])
    return out


def representatives(docs: DataFrame, text: str = "text", id_: str = "doc_id", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id): the smallest id of each group of near copies; documents without an id are in none.

    Fingerprints are linked up to one standard deviation beyond the expected distance at the similarity.
    """
    tuned(docs.sparkSession)
    names = [f"w{j}" for j in range(WIDE)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                wide = wide_fingerprints(part.column("text"), shingle).view(np.int64)
                yield pa.record_batch([part.column("id"), *(pa.array(wide[:, j]) for j in range(WIDE))], ["id", *names])

    rows = docs.select(docs[id_].cast("long").alias("id"), docs[text].cast("string").alias("text")).where("id is not null")
    rows = rows.mapInArrow(tidied(prints), "id long, " + ", ".join(f"{n} long" for n in names))
    table = written(rows.groupBy(*names).agg(F.min("id").alias("v")))
    share = distance_of(similarity)
    radius = math.ceil(64 * WIDE * share + math.sqrt(64 * WIDE * share * (1 - share)))
    masks = samples_of(table.count(), share)
    keys = [F.xxhash64(F.lit(t), *[F.col(n).bitwiseAND(F.lit(_signed(m))) for n, m in zip(names, mask, strict=True) if m]) for t, mask in enumerate(masks)]
    keyed = table.select("v", *names, F.explode(F.array(*keys)).alias("k"))
    found = components(_compared(keyed.repartition("k").sortWithinPartitions("k", "v"), ["k"], names, "v", radius))
    return table.select("v").join(found.where("v <> root").select("v"), "v", "left_anti").select(F.col("v").alias("doc_id"))


def op10(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
