"""Packing of documents into training sequences along a space-filling curve.

Pieces of a document, and each character that the tokenizer's lexer leaves to the library (it has no sure class), are hashed into a signed count vector, which is scaled to length one and projected to four dimensions;
its cell's Hilbert key orders documents so that neighbours are alike.  Keys are range-sorted by splitters from a sample
of documents, and each range is cut into sequences along the curve: a document that doesn't fit goes on in the next one,
and the rest of a range is cut into powers of two, so no sequence needs padding.

A range holds some megabytes of tokens and follows on the one before it along the curve: the sample grows with the number of
ranges.  Equal keys (copies) are told apart by id.  Edge cases: null and empty texts
consist of the end id alone; null ids sort first and stay null; rows with equal ids are packed one after the other; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixdedup import _pack, _unpack
from .textops import U64, slices, tidied, tuned
from .transducer import Encoded

LENGTH, END_ID = 4096, 2
BUCKETS, DIMENSIONS, BITS = 256, 4, 15
#: Bytes of text in a range, and documents in the sample for so many ranges, or the first of them.
RANGE_BYTES, SAMPLED, RANGES = 8 << 20, 4000, 1000
_NONE = np.iinfo(np.int64).min


def _projection() -> np.ndarray:
    basis, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS)))
    return basis


PROJECTION = _projection()


def hilbert(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of cells (rows of unsigned coordinates), by Skilling's transposed form."""
    x = [c.astype(np.int64) for c in cell.T]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            first = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
            x[0] = first
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | ((c >> b) & 1)
    return key


def curve_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hilbert key of each text from the hashes of its pieces."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    sign = ((h >> U64(63)).astype(np.float64)) * 2 - 1
    vector = np.bincount(text * BUCKETS + (h % U64(BUCKETS)).astype(np.int64), sign, n * BUCKETS).reshape(n, BUCKETS)
    low = vector @ PROJECTION
    low /= np.maximum(np.linalg.norm(vector, axis=1), 1e-9)[:, None]
    top = (1 << BITS) - 1
    return hilbert(np.clip((low + 0.6) / 1.2 * top, 0, top).astype(np.int64))


def cuts(total: int, length: int) -> np.ndarray:
    """Sequence starts, and the end: whole sequences, then powers of two for the rest."""
    whole, rest = divmod(total, length)
    out = [*range(0, whole * length + 1, length)]
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            out.append(out[-1] + (1 << b))
    return np.array(out, np.int64)


def packed(docs: DataFrame, text: str = "text", id_: str = "doc_id", tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (unsigned 32-bit, little-endian) if asked for.

    length: a power of two.
    """
    tuned(docs.sparkSession)
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = docs.select(docs[id_].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    count, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_ranges = int(total // RANGE_BYTES) + 1
    n_sampled = SAMPLED * -(-n_ranges // RANGES)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Encoded.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                _, _, h, bounds = machine.encode(part.column("text"))
                yield pa.record_batch({"key": curve_keys(h, bounds), "id": part.column("id").fill_null(_NONE)})

    sampled = docs.sample(min(1.0, n_sampled / max(count, 1)), 5) if n_ranges > 1 else docs.limit(0)
    points = np.array(sorted(tuple(r) for r in sampled.mapInArrow(tidied(keys), "key long, id long").collect()), np.int64).reshape(-1, 2)
    split = points[[len(points) * i // n_ranges for i in range(1, n_ranges)]] if len(points) else points

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Encoded.of(tokenizer)
        pairs = split.copy().view([("k", np.int64), ("i", np.int64)]).ravel() if len(split) else None
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, cut, h, bounds = machine.encode(piece.column("text"))
                key, doc = curve_keys(h, bounds), piece.column("id").fill_null(_NONE).to_numpy()
                n = np.diff(cut)
                if pairs is None:
                    part = np.zeros(len(doc), np.int64)
                else:
                    # the first splitter beyond (key, id)
                    part = np.searchsorted(split[:, 0], key)
                    tie = np.searchsorted(split[:, 0], key, "right")
                    for i in np.flatnonzero(tie > part):
                        part[i] += np.searchsorted(split[part[i] : tie[i], 1], doc[i], "right")
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.unique(part))
                for rows in np.split(order, at[1:]):
                    some = np.concatenate([ids[cut[i] : cut[i + 1]] for i in rows])
                    kind = 2 if not len(some) or some.max() < 1 << 16 else 4
                    yield pa.record_batch({"part": pa.array([part[rows[0]]], pa.int64()), "data": pa.array([_pack(doc[rows], key[rows], n[rows], some.astype(f"<u{kind}"))], pa.binary())})

    def pack(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        parts = []
        for x in rows.column("data"):
            doc, key, n, ids = _unpack(x.as_py(), np.int64, np.int64, np.int64, np.uint8)
            parts.append((doc, key, n, ids.view("<u2" if len(ids) == 2 * n.sum() else "<u4")))
        doc, key, n, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((n, doc, key))
        first = np.cumsum(n) - n
        size = n[order] + 1
        begin = np.cumsum(size) - size
        sequence = cuts(int(size.sum()), length)
        starts = np.union1d(begin, sequence[:-1])
        ends = np.concatenate((starts[1:], sequence[-1:]))
        d = np.searchsorted(begin, starts, "right") - 1
        s = np.searchsorted(sequence, starts, "right") - 1
        crc, blobs = np.empty(len(starts), np.int64), []
        held, whole = -1, np.zeros(0, "<u4")
        for i, (a, b, j) in enumerate(zip(starts.tolist(), ends.tolist(), d.tolist(), strict=True)):
            if j != held:
                o = order[j]
                whole, held, base = np.append(ids[first[o] : first[o] + n[o]], end_id).astype("<u4"), j, int(begin[j])
            data = whole[a - base : b - base].tobytes()
            crc[i] = zlib.crc32(data)
            if with_ids:
                blobs.append(data)
        own = doc[order][d]
        out = {"doc_id": pa.array(own, pa.int64(), mask=own == _NONE), "start": starts - begin[d], "length": ends - starts, "ids_crc32": crc, "doc_tokens": size[d], "sequence_id": (part << 32) + s, "offset": starts - sequence[s]}
        return pa.table(out | ({"ids": pa.array(blobs, pa.binary())} if with_ids else {}))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.mapInArrow(tidied(encode), "part long, data binary").groupBy("part").applyInArrow(pack, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
