"""WARC archives: a writer in DataFrame operations, and a Python data source that reads them.

Writing: of pages with equal payloads (SHA-1) of at least REVISIT bytes, that with the largest id is a response record, the others
are revisit records that refer to it.  A record is one string, and the text sink's line separator ends it, so any
file system that Spark writes to will do.

Reading: one partition for each archive file.  Filters on the record type and on header columns are pushed into
the source: a record's headers are read first, and the payload of a record that they rule out, or that nobody asks for, is
skipped by a seek.

Edge cases: null html is an empty payload; null ids are kept as null, and are smaller than any id; rows with the id that is the
largest of their payload are all responses; white space and control characters in a URL are written as %20; an empty
table makes an archive without records.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from ..tables import shared_folder
from .textops import checkpointed, tuned

REVISIT = 1000
#: Payload digests with copies that are broadcast, at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "type string, record_id string, page_id long, target_uri string, refers_to string, payload_digest string, payload_bytes long, content_length long, payload_sha1 string, payload binary"
#: Columns that come from headers alone.
HEADED = {"type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def write(pages: DataFrame, path: str, id_: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record for each row of pages as archive files in a folder."""
    spark = tuned(pages.sparkSession)
    body = F.coalesce(pages[html].cast("string"), F.lit(""))
    rows = pages.select(pages[id_].cast("long").alias("id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"))
    light = rows.where(F.col("size") >= REVISIT).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    light = checkpointed(light)
    copies = F.broadcast(light) if light.count() <= BROADCAST_ROWS else light
    rows = rows.join(copies.withColumnRenamed("digest", "copied"), (F.col("digest") == F.col("copied")) & (F.col("size") >= REVISIT), "left")
    revisit = F.coalesce(F.coalesce(F.col("id"), F.lit(-(1 << 63))) < F.col("first"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    content = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), "body"))
    heads = [
        F.when(revisit, F.lit("WARC/1.1\r\nWARC-Type: revisit")).otherwise(F.lit("WARC/1.1\r\nWARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *heads), F.lit("\r\n\r\n"), content)
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    spark.dataSource.register(WarcDataSource)


def opened(path: str):
    """A seekable file of a local path or of a URI that pyarrow knows."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listed(path: str) -> list[str]:
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        folder = unquote(parts.path)
        if os.path.isfile(folder):
            return [folder]
        return sorted(f"{folder}/{n}" for n in os.listdir(folder) if n[0] not in "._")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(f"{parts.scheme}://{parts.netloc}/{i.path.lstrip('/')}" for i in found if i.is_file and i.base_name[0] not in "._")


def _page(value: str | None) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(match[1]) if match else None


def records(file, wanted=lambda head: True, payload: str = "bytes") -> Iterator[tuple[dict[str, str], bytes | None, str | None, int | None]]:
    """(headers, payload, its SHA-1, its length) of the wanted records of an archive; a payload is read if asked for: "bytes", "digest" or "none"."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := file.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            head[key.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        if not wanted(head) or payload == "none" or not size:
            file.seek(size, 1)
            if wanted(head):
                yield head, None, None, None
            continue
        block = file.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        if head.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield head, block if payload == "bytes" else None, hashlib.sha1(block).hexdigest(), len(block)


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str) -> None:
        self.path, self.payload = path, payload
        self.equal: dict[str, set] = {}
        self.present: dict[str, bool] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name in HEADED and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, values) & values
            elif name in HEADED and isinstance(f, (IsNotNull, IsNull)):
                self.present[name] = isinstance(f, IsNotNull)
                yield f  # a column can be asked to be both; Spark looks again
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Archive(p) for p in listed(self.path)] or [Archive("")]

    def _wanted(self, head: dict[str, str]) -> bool:
        return all(head.get(HEADED[n]) in v for n, v in self.equal.items()) and all((head.get(HEADED[n]) is not None) == v for n, v in self.present.items())

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, size = [], 0
        with opened(partition.path) as file:
            for head, body, digest, n in records(file, self._wanted, self.payload):
                rows.append((*(head.get(HEADED[n]) for n in ("type", "record_id")), _page(head.get("warc-record-id")), *(head.get(HEADED[n]) for n in ("target_uri", "refers_to", "payload_digest")), n if n is not None else int(head["x-payload-length"]) if "x-payload-length" in head else None, int(head.get("content-length", 0)), digest, body))
                size += len(body or b"") + 400
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "bytes" | "digest" | "none").load(folder or file)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "bytes"))


def read(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    tuned(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def op4(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    kinds = F.col("type").isin("response", "revisit")
    got = read(spark, folder, "digest").where(kinds)
    empty = F.sha1(F.lit(b""))
    response = F.col("type") == "response"
    digest = F.when(response, F.coalesce("payload_sha1", empty)).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    refers = F.when(~response, F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1).cast("long"))
    return got.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), refers.alias("refers_to"))
