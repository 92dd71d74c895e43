"""Exact removal of repeated substrings by sorted suffixes.

A byte goes if it lies in a `window`-byte string that also starts earlier (smaller id, or the same document further
left), judged on the input.  Sorting every suffix of the corpus would shuffle it a hundred times over, so only suffixes
at anchors are sorted.  An anchor is the start of a 32-byte gram whose hash is least in some window; equal windows have
their anchor at the same place, so equal windows always meet at equal anchored suffixes and no match is lost:

1. blocks: texts are gathered into blocks of a few megabytes (one row each, checkpointed), which all later steps share;
2. filter: each block lists its distinct anchor hashes once; those that no other block has need no further look;
3. local: within a block, anchored suffixes are sorted and repeated windows are settled (the map-side combine);
4. global: windows that are left go, as the bytes around their anchor, to the range of sampled splitters (100-byte
   strings) that their suffix's leading bytes fall in; each range is sorted by multikey quicksort on 8-byte symbols, and
   neighbours are compared.  All suffixes with equal leading bytes fall in one range, so no match crosses a boundary.
   An anchor that very many blocks have sends single windows instead, each dealt by its own 100 bytes; as a block sends
   a window once, no range gets more than a row from each block for one string;
5. spans return to their blocks, are merged, and cut out.

Edge cases: null and empty texts and texts shorter than the window lose nothing; null ids count as the smallest;
rows with equal ids are ordered by block and row; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U64, Rolling, checkpointed, flat, ranges, slices, tidied, tuned

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
BLOCK_BYTES = 1 << 21
#: Anchors in a range or bucket, about; and blocks with one anchor from which its windows travel alone.
BUCKET_ANCHORS, HOT_BLOCKS = 200_000, 512
#: Blocks that give splitter candidates, at most, and candidates of each.
SAMPLED_BLOCKS, SAMPLES = 2000, 24
_LOW = U64(0xFFFFFFFF)


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of span values, by doubling, in pieces that fit the cache."""
    n = len(key) - span + 1
    out = np.empty(max(n, 0), key.dtype)
    for at in range(0, n, 1 << 15):
        m = key[at : min(at + (1 << 15), n) + span - 1]
        width = 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        out[at : at + (1 << 15)] = np.minimum(m[: len(m) - (span - width)], m[span - width :]) if span > width else m
    return out


class Anchors:
    """Anchors of a block: position `at`, hash `h`, first and last window start `lo`, `hi`, and row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        starts = np.maximum(np.diff(offsets) - WINDOW, 0)  # the separator isn't text
        window = ranges(offsets[:-1], starts)
        if not len(window):
            self.at = self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.h = np.zeros(0, U64)
            return
        key = Rolling(raw).grams(GRAM)
        key &= ~_LOW
        key |= np.arange(len(key), dtype=U64)
        owner = (_least(key, SPAN) & _LOW).astype(np.uint32)[window]
        del key
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        self.at, self.lo = owner[first].astype(np.int64), window[first]
        self.hi = window[np.append(first[1:], len(window)) - 1]
        del owner, window
        self.h = Rolling(raw).of(self.at, self.at + GRAM) >> U64(16)
        self.row = np.searchsorted(offsets, self.at, "right") - 1


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Multikey quicksort of rows of big-endian symbols: rows are split by the first symbol, and only groups of equal rows go on to the next."""
    n, depth = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    if n < 2:
        return order
    cut = np.concatenate(([True], words[order[1:], 0] != words[order[:-1], 0]))
    for d in range(1, depth):
        group = np.cumsum(cut)
        tied = np.flatnonzero(~cut | np.concatenate((~cut[1:], [False])))
        if not len(tied):
            break
        rows = order[tied]
        symbol = words[rows, d]
        if (symbol[1:] == symbol[:-1]).all():
            continue
        inner = np.lexsort((symbol, group[tied]))
        order[tied] = rows[inner]
        symbol, same = symbol[inner], group[tied][1:] == group[tied][:-1]
        cut[tied[1:][same]] = symbol[1:][same] != symbol[:-1][same]
    return order


def _shared(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of bytes with the row before."""
    same = rows[1:] == rows[:-1]
    return np.concatenate(([0], np.where(same.all(1), rows.shape[1], same.argmin(1))))


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = multikey_order(rows.view(">u8").astype(U64))
    return order, _shared(rows[order])


def repeated(raw: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows also start earlier: a row for each anchor, a column for each distance s of the anchor from the window's start.

    Windows of shift s are equal if s bytes before and 100 - s bytes from the anchor are.  Both are intervals of a sorted
    order: of the suffixes from the anchors, and of the reversed prefixes before them.
    """
    n = len(at)
    out = np.zeros((n, SPAN), bool)
    if n < 2:
        return out
    right, left = np.zeros((n, 104), np.uint8), np.zeros((n, 72), np.uint8)
    for a in range(0, n, 1 << 13):
        b = slice(a, a + (1 << 13))
        i = at[b, None] + np.arange(104)
        inside = i < end[b, None]
        right[b] = np.where(inside, raw[np.minimum(i, len(raw) - 1)], 0)
        i = at[b, None] - 1 - np.arange(72)
        left[b] = np.where(i >= lo[b, None], raw[np.maximum(i, 0)], 0)
    (r_order, r_shared), (l_order, l_shared) = _sorted(right), _sorted(left)
    del right, left
    r_id, l_id = np.zeros(n, U64), np.zeros(n, U64)
    bits = U64(max(1, int(n).bit_length()))
    low, high = at - hi, at - lo
    for s in range(SPAN):
        r_id[r_order] = np.cumsum(r_shared < WINDOW - s)
        l_id[l_order] = np.cumsum(l_shared < s)
        has = np.flatnonzero((low <= s) & (s <= high))
        if len(has) < 2:
            continue
        if bits <= 21:
            key = np.sort((((r_id[has] << bits) | l_id[has]) << bits) | rank[has].astype(U64))
            dup = np.concatenate(([False], (key[1:] >> bits) == (key[:-1] >> bits)))
            who = (key[dup] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        else:
            o = np.lexsort((rank[has], l_id[has], r_id[has]))
            r, left_ = r_id[has][o], l_id[has][o]
            who = rank[has][o][1:][(r[1:] == r[:-1]) & (left_[1:] == left_[:-1])]
        out[who, s] = True
    by_rank = np.empty(n, np.int64)
    by_rank[rank] = np.arange(n)
    out2 = np.zeros_like(out)
    out2[by_rank] = out
    return out2


def _spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first s, last s) of the runs of true values in each row."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).view(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, a, b - 1


def _rank(*keys: np.ndarray) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a) for a in arrays]
    head = struct.pack(f"<{len(parts)}q", *(p.nbytes for p in parts))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in parts))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", data), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _six(h: np.ndarray) -> np.ndarray:
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]


def _from_six(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    full = np.zeros((len(six), 8), np.uint8)
    full[:, 2:] = six
    return full.view(">u8").ravel().astype(U64)


def _read(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0]


def blocks(docs: DataFrame, text: str) -> DataFrame:
    """(block, n_bytes, sample, rows): rows is an Arrow stream of some rows of docs, all columns."""
    at = docs.columns.index(text)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as out:
                out.write_table(rows, max_chunksize=rows.num_rows)
            column = rows.column(at)
            raw, _ = flat(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))
            places = np.random.default_rng(len(raw)).integers(0, max(1, len(raw) - WINDOW), SAMPLES)
            sample = b"".join(raw[p : p + WINDOW].tobytes().ljust(WINDOW, b"\0") for p in places.tolist())
            return pa.record_batch({"block": pa.array([(part << 32) | made], pa.int64()), "n_bytes": pa.array([len(raw)], pa.int64()), "sample": pa.array([sample], pa.binary()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for piece in slices(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{at}", BLOCK_BYTES):
                if held and size + piece.nbytes > BLOCK_BYTES:
                    yield block()
                    held, size, made = [], 0, made + 1
                held.append(piece)
                size += piece.nbytes
        if held:
            yield block()

    return checkpointed(docs.mapInArrow(tidied(gather), "block long, n_bytes long, sample binary, rows binary"))


def repeated_spans(table: DataFrame, text_at: int, id_at: int) -> DataFrame:
    """table: blocks.  (block, spans): packed (row, start, end) of the bytes to remove, some for each block, not merged."""
    total, count = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    buckets = max(64, int(total * 2 / (SPAN + 1) / BUCKET_ANCHORS) + 1)
    ranges_ = max(12, int(total * 2 / (SPAN + 1) / BUCKET_ANCHORS) + 1)
    sampled = table if count <= SAMPLED_BLOCKS else table.sample(SAMPLED_BLOCKS / count, 7).limit(2 * SAMPLED_BLOCKS)
    points = sorted(x for r in sampled.select("sample").toLocalIterator() for x in (r[0][i : i + WINDOW] for i in range(0, len(r[0]), WINDOW)))
    splitters = np.array(sorted({points[len(points) * i // ranges_] for i in range(1, ranges_)}) if points else [], dtype=f"S{WINDOW}")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                raw, offsets = flat(_read(rows.as_py()).column(text_at))
                h = np.unique(Anchors(raw, offsets).h)
                bucket = ((h >> U64(16)) * U64(buckets) >> U64(32)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                has = np.flatnonzero(np.diff(cut))
                yield pa.record_batch({"bucket": pa.array(has, pa.int64()), "block": pa.array(np.full(len(has), block), pa.int64()), "hashes": pa.array([_six(h[cut[b] : cut[b + 1]]).tobytes() for b in has], pa.binary())})

    def common(rows: pa.Table) -> pa.Table:
        lists = [_from_six(x.as_py()) for x in rows.column("hashes")]
        h, count = np.unique(np.concatenate(lists), return_counts=True)
        h, count = h[count > 1], count[count > 1]
        out = []
        for x in lists:
            at = np.searchsorted(h, x)
            hit = h[np.minimum(at, len(h) - 1)] == x if len(h) else np.zeros(len(x), bool)
            out.append(_pack(x[hit], count[at[hit]] >= HOT_BLOCKS))
        return pa.table({"block": rows.column("block"), "common": pa.array(out, pa.binary())})

    replies = table.select("block", "rows").mapInArrow(tidied(listed), "bucket long, block long, hashes binary").groupBy("bucket").applyInArrow(common, "block long, common binary")
    replies = replies.groupBy("block").agg(F.collect_list("common").alias("common"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows, common_ in zip(batch.column("block").to_pylist(), batch.column("rows"), batch.column("common").to_pylist(), strict=True):
                held = _read(rows.as_py())
                raw, offsets = flat(held.column(text_at))
                a = Anchors(raw, offsets)
                lists = [_unpack(x, U64, bool) for x in common_ or []]
                h = np.concatenate([x for x, _ in lists]) if lists else np.zeros(0, U64)
                hot = np.concatenate([x for _, x in lists]) if lists else np.zeros(0, bool)
                order = np.argsort(h)
                h, hot = h[order], hot[order]
                spot = np.minimum(np.searchsorted(h, a.h), max(0, len(h) - 1))
                shared = h[spot] == a.h if len(h) else np.zeros(len(a.h), bool)
                own, inverse, times = np.unique(a.h, return_inverse=True, return_counts=True)
                take = np.flatnonzero(shared | (times[inverse] > 1))
                at, lo, hi, row = a.at[take], a.lo[take], a.hi[take], a.row[take]
                ids = held.column(id_at).cast(pa.int64())
                ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                marks = repeated(raw, at, lo, hi, hi + WINDOW, _rank(ids[row], row, at))
                r, s0, s1 = _spans(marks)
                start = at[r] - s1 - offsets[row[r]]
                done = _pack(row[r].astype(np.int32), start, at[r] - s0 + WINDOW - offsets[row[r]])
                yield _rows([(0, block % (len(splitters) + 1), block, done)])
                # windows that are the block's first: their hull goes on, if another block has the anchor
                s = np.arange(SPAN)
                left = ~marks & (s >= (at - hi)[:, None]) & (s <= (at - lo)[:, None]) & shared[take][:, None]
                is_hot = hot[spot[take]] if len(hot) else np.zeros(len(take), bool)
                go = np.flatnonzero(left.any(1) & ~is_hot)
                far, near = SPAN - 1 - left[go][:, ::-1].argmax(1), left[go].argmax(1)
                k, alone = np.nonzero(left & is_hot[:, None])
                at_ = np.concatenate((at[go], at[k] - alone))
                first, last = np.concatenate((at[go] - far, at[k] - alone)), np.concatenate((at[go] - near, at[k] - alone))
                row_ = np.concatenate((row[go], row[k]))
                if not len(at_):
                    continue
                lead = np.zeros((len(at_), WINDOW), np.uint8)
                lead[: len(go), :GRAM] = raw[at_[: len(go), None] + np.arange(GRAM)]
                lead[len(go) :] = raw[at_[len(go) :, None] + np.arange(WINDOW)]
                to = np.searchsorted(splitters, lead.view(f"S{WINDOW}").ravel(), "right")
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(len(splitters) + 2))
                for b in np.flatnonzero(np.diff(cut)):
                    i = order[cut[b] : cut[b + 1]]
                    size = last[i] - first[i] + WINDOW
                    yield _rows([(1, int(b), block, _pack(raw[ranges(first[i], size)], size.astype(np.int32), (at_[i] - first[i]).astype(np.uint8), ids[row_[i]], row_[i].astype(np.int32), first[i] - offsets[row_[i]]))])

    found = table.select("block", "rows").join(replies, "block", "left").mapInArrow(tidied(local), "kind int, key long, block long, data binary")

    def settle(rows: pa.Table) -> pa.Table:
        settled = rows.filter(pc.equal(rows.column("kind"), 0)).select(["block", "data"]).rename_columns(["block", "spans"])
        rows = rows.filter(pc.equal(rows.column("kind"), 1))
        if not rows.num_rows:
            return settled
        parts = [_unpack(x.as_py(), np.uint8, np.int32, np.uint8, np.int64, np.int32, np.int64) for x in rows.column("data")]
        block = np.repeat(rows.column("block").to_numpy(), [len(p[1]) for p in parts])
        raw, size, shift, ids, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = size.astype(np.int64)
        lo = np.cumsum(size) - size
        at = lo + shift
        marks = repeated(raw, at, lo, lo + size - WINDOW, lo + size, _rank(ids, block, row.astype(np.int64), start))
        r, s0, s1 = _spans(marks)
        order = np.argsort(block[r], kind="stable")
        r, s0, s1 = r[order], s0[order], s1[order]
        who, cut = np.unique(block[r], return_index=True)
        base = start[r] + shift[r]
        data = [_pack(row[r[a:b]], base[a:b] - s1[a:b], base[a:b] - s0[a:b] + WINDOW) for a, b in zip(cut, np.append(cut[1:], len(r))[: len(cut)], strict=True)]
        return pa.concat_tables([settled, pa.table({"block": pa.array(who, pa.int64()), "spans": pa.array(data, pa.binary())})])

    # spans that are settled go along, so that what is found is made once and needn't be kept
    return found.groupBy("key").applyInArrow(settle, "block long, spans binary")


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, key, block, data = zip(*rows, strict=True)
    return pa.record_batch({"kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64()), "block": pa.array(block, pa.int64()), "data": pa.array(data, pa.binary())})


#: What without_repeats() adds.
ADDED = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("text", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def without_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id", into: str = "repeats") -> DataFrame:
    """docs with a struct column `into` added: kept bytes, the same as text without broken characters, n_bytes, n_removed, and the maximal removed spans [start, end)."""
    tuned(docs.sparkSession)
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    docs = docs.withColumn(text, F.col(text).cast("string"))
    table = blocks(docs, text)
    spans = repeated_spans(table, docs.columns.index(text), docs.columns.index(id_))
    spans = spans.groupBy("block").agg(F.collect_list("spans").alias("spans"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)] + [T.StructField("added", ADDED)])
    text_at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, spans_ in zip(batch.column("rows"), batch.column("spans").to_pylist(), strict=True):
                held = _read(rows.as_py())
                raw, offsets = flat(held.column(text_at))
                gone = np.zeros(len(raw) + 1, np.int32)
                for x in spans_ or []:
                    row, start, end = _unpack(x, np.int32, np.int64, np.int64)
                    np.add.at(gone, offsets[row] + start, 1)
                    np.add.at(gone, offsets[row] + end, -1)
                gone = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                a, b = edge[::2], edge[1::2]
                first = np.searchsorted(a, offsets)
                keep = ~gone
                kept, n_removed, lists = [], [], []
                for d in range(len(offsets) - 1):
                    x, y = offsets[d], offsets[d + 1] - 1
                    i, j = first[d], first[d + 1]
                    kept.append(raw[x:y].tobytes() if i == j else raw[x:y][keep[x:y]].tobytes())
                    n_removed.append(int((b[i:j] - a[i:j]).sum()))
                    lists.append([[int(u - x), int(v - x)] for u, v in zip(a[i:j], b[i:j], strict=True)])
                added = pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array([k.decode(errors="ignore") for k in kept], pa.string()), pa.array(np.diff(offsets) - 1, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int64())))], ["kept", "text", "n_bytes", "n_removed", "spans"])
                yield pa.RecordBatch.from_arrays([*held.columns, added], [*(f"c{i}" for i in range(held.num_columns)), "added"])

    return table.select("block", "rows").join(spans, "block", "left").mapInArrow(tidied(cut), schema).toDF(*docs.columns, into)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = F.col("repeats")
    return without_repeats(docs).select("doc_id", r.n_bytes.alias("n_bytes"), r.n_removed.alias("n_removed"), F.size(r.spans).cast("long").alias("n_spans"), F.sha2(r.kept, 256).alias("kept_sha256"))
