"""Interleaved documents: ordered text and media-reference structs, and a media store joined by digest.

sequences() reads HTML into items (position, kind, text, ref, caption): text blocks and media references in page order, a
reference with its caption (figcaption, else alt text).  stored() keeps each distinct payload once, losslessly, as an 8-bit
RGB image of 64 pixels a row (PNG: payload bytes are samples, padded with spaces to whole rows), keyed by the payload's SHA-256.
described() reads stored images back and computes features once for each digest.  resolved() joins references to the
store by digest and puts the items back in order, so positions and captions stay aligned; a reference that the store
doesn't have keeps its place with a null.

Copies of a payload meet in one row before anything large is shuffled (each task sends a digest once), and what is joined
to references are features, not payloads.  Edge cases: null and empty payloads are one row of spaces; null html has no
items; repeated rows keep a row each.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pagediff import BLOCKS, SILENT, TOKEN
from .textops import checkpointed, slices, tidied, tuned

#: Bytes of an image row: 64 pixels of three samples.
ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SOURCE = re.compile(r"""\b(src|alt)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MEDIA = {"img", "video", "audio", "source", "embed"}

ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of a row."""
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload (a multiple of a row)."""
    rows = len(payload) // ROW
    samples = np.zeros((rows, ROW + 1), np.uint8)  # filter type 0 before each row
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)
    chunks = ((b"IHDR", head), (b"IDAT", zlib.compress(samples.tobytes(), 1)), (b"IEND", b""))
    return _SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def decode(image: bytes) -> bytes:
    """The samples of such a PNG; ValueError for anything else."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, rows, data = 8, 0, 0, b""
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 2):
                raise ValueError("only 8-bit RGB is stored")
        elif kind == b"IDAT":
            data += body
        at += n + 12
    samples = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, 3 * width + 1)
    if samples[:, 0].any():
        raise ValueError("only filter type 0 is stored")
    return samples[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, means by channel, deviation, entropy in bits, and a 64-bit average hash over an 8 x 8 grid."""
    samples = np.frombuffer(payload, np.uint8)
    count = np.bincount(samples, minlength=256)
    share = count[count > 0] / len(samples)
    value = np.arange(256)
    mean = (count * value).sum() / len(samples)
    spread = ((count * value**2).sum() / len(samples) - mean**2) ** 0.5
    channels = np.add.reduceat(samples.reshape(-1, 3).astype(np.int64), [0])[0] * 3 / len(samples)
    edges = np.arange(64) * len(samples) // 64
    cells = np.add.reduceat(samples, edges, dtype=np.int64) / np.diff([*edges, len(samples)])
    bits = int("".join("1" if c else "0" for c in cells > cells.mean()), 2)
    return f"rows={len(samples) // ROW};rgb={channels[0]:.4f},{channels[1]:.4f},{channels[2]:.4f};sd={spread:.4f};entropy={-(share * np.log2(share)).sum():.4f};hash={bits:016x}"


def items(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """Ordered (position, kind, text, ref, caption)."""
    out: list[list] = []
    parts: list[str] = []
    figures: list[int] = []
    caption = False
    page = page or ""

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if not text:
            return
        if caption and figures:
            for item in out[figures[-1] :]:
                if item[0] == "media":
                    item[3] = text if item[4] else f"{item[3]} {text}" if item[3] else text
                    item[4] = False  # what follows of the caption is appended
        else:
            out.append(["text", text, None, None, False])

    at, match = 0, TOKEN.search(page)
    while match:
        parts.append(page[at : match.start()])
        at = match.end()
        tag, closing = (match[2] or "").lower(), bool(match[1])
        if tag in MEDIA:
            got = {k.lower(): a or b or c for k, a, b, c in _SOURCE.findall(match[3] or "")}
            if not closing and got.get("src"):
                flush()
                alt = entities.unescape(got.get("alt", "")).strip()
                # an alt text gives way to a figcaption
                out.append(["media", None, entities.unescape(got["src"]), alt or None, True])
        elif tag in SILENT and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in BLOCKS:
            flush()
            if tag == "figure":
                figures = [*figures, len(out)] if not closing else figures[:-1]
            elif tag == "figcaption":
                caption = not closing
        elif tag == "br":
            parts.append(" ")
        match = TOKEN.search(page, at)
    parts.append(page[at:])
    flush()
    return [(i, *item[:4]) for i, item in enumerate(out)]


def sequences(pages: DataFrame, html: str = "html", into: str = "items") -> DataFrame:
    """pages with the array of items in place of the html."""
    tuned(pages.sparkSession)
    if into in pages.columns:
        raise ValueError(f"there is a column {into} already")
    names = [c for c in pages.columns if c != html]
    pages = pages.select(*[pages[c] for c in names], pages[html].cast("string")).toDF(*[f"c{i}" for i in range(len(names))], "html")
    schema = T.StructType([*pages.schema.fields[:-1], T.StructField("items", T.ArrayType(ITEM))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for part in slices(batch, "html"):
                found = [[dict(zip(ITEM.names, i, strict=True)) for i in items(h)] for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], schema.names)

    return pages.mapInArrow(tidied(read), schema).toDF(*names, into)


def stored(payloads: Column, rows: DataFrame) -> DataFrame:
    """(digest, media): each distinct padded payload of a column once; digest is the hex SHA-256 of the payload."""
    tuned(rows.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "payload"):
                digests, media = [], []
                for x in part.column("payload"):
                    data = pad(x.as_py() or b"")
                    key = hashlib.sha256(data)
                    if key.digest() not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(key.digest())
                        digests.append(key.hexdigest())
                        media.append(encode(data))
                yield pa.record_batch({"digest": pa.array(digests, pa.string()), "media": pa.array(media, pa.binary())})

    made = rows.select(payloads.cast("binary").alias("payload")).mapInArrow(tidied(keep), "digest string, media binary")
    return made.groupBy("digest").agg(F.first("media").alias("media"))


DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(store: DataFrame) -> DataFrame:
    """What is read back from each stored image."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DESCRIBED.split(", ")]
        for batch in batches:
            for part in slices(batch, "media"):
                out = []
                for digest, image in zip(part.column("digest").to_pylist(), part.column("media"), strict=True):
                    image = image.as_py()
                    data = decode(image)
                    out.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)))
                if out:
                    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in DESCRIBED.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return store.mapInArrow(tidied(read), DESCRIBED)


def resolved(documents: DataFrame, features: DataFrame, items_: str = "items", into: str = "media") -> DataFrame:
    """documents with an array beside the items: of each item the features of the digest that it refers to ("sha256:..."), or null."""
    names = documents.columns
    # the row number is fixed by the checkpoint, and tells repeated rows apart
    rows = checkpointed(documents.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()))
    at = f"c{names.index(items_)}"
    refs = rows.select("row", F.explode(at).alias("item")).where("item.kind = 'media' and item.ref like 'sha256:%'")
    refs = refs.select("row", "item.position", F.substring("item.ref", 8, 64).alias("digest"))
    fields = [c for c in features.columns if c != "digest"]
    found = refs.join(features, "digest").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("digest", *fields)))).alias("found"))
    aligned = F.when(F.col("found").isNotNull(), F.transform(at, lambda i: F.col("found")[i.position])).otherwise(F.transform(at, lambda i: F.lit(None).cast(found.schema["found"].dataType.valueType)))
    return rows.join(found, "row", "left").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], aligned.alias(into))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    size = F.octet_length("payload")
    whole = F.greatest(F.lit(1), F.ceil(size / ROW)) * ROW
    digest = F.sha2(F.rpad("payload", whole.cast("int"), F.lit(b" ")), 256)
    # each document is a page with one figure, whose image is the text's bytes
    page = F.concat(F.lit("<article><p>"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), size.cast("string"), F.lit("</figcaption></figure></article>"))
    pages = sequences(docs.select("doc_id", page.alias("html")))
    out = resolved(pages, described(stored(F.col("payload"), docs)))
    of = F.filter(F.arrays_zip("items", "media"), lambda x: x["items"].kind == "media")[0]
    m = of["media"]
    return out.select("doc_id", of["items"].caption.cast("long").alias("n_bytes"), *[m[c].alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
