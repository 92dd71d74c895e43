"""Alignments: SAM text by Spark's reader, BAM by a Python data source.

A BAM file is BGZF: blocks that are gzip members of their own.  The planner walks the block headers (18 bytes each), decodes
the leading blocks for the header, and cuts the rest into ranges of blocks; a range starts at the first record that begins in it, which
it finds by reading on from a position that passes a run of checks on consecutive records.  Names come grouped, not whole, from a
range, so pairing shuffles by name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..deploy import ship
from ..functions.prefix import dense_ids

SCHEMA = "ord long, query_name string, flag int, ref_id int, pos long, mapq int, cigar array<struct<op:int,len:int>>, alen long"
# The CIGAR operations by number, those that use the reference, and the block size of a range.
OPERATIONS = "MIDNSHP=X"
ON_REFERENCE = (0, 2, 3, 7, 8)
RANGE_BYTES = 32 << 20


class SortOrderError(OSError):
    """The alignments aren't sorted by query name."""


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, name, length) of a SAM file's header; its sort order must be queryname."""
    lines = spark.read.text(path).where(F.col("value").startswith("@"))
    order = [r[0] for r in lines.where(F.col("value").startswith("@HD")).select(F.regexp_extract("value", r"\tSO:(\S+)", 1)).limit(1).collect()]
    if order != ["queryname"]:
        raise SortOrderError(f"the sort order must be queryname, not {order[0] if order else 'unknown'}")
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ")).select(F.monotonically_increasing_id().alias("_at"), F.regexp_extract("value", r"\tSN:(\S+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    return dense_ids(rows, "_at", "ref_id").select("ref_id", "name", "length")


def read_sam(spark: SparkSession, path: str, references: DataFrame) -> DataFrame:
    """Alignments of a SAM file; references: ref_id, name.  ord follows the file."""
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("ord", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    rows = rows.select("ord", f[0].alias("query_name"), f[1].cast("int").alias("flag"), f[2].alias("_name"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("_cigar"))
    cigar = F.expr(r"transform(regexp_extract_all(_cigar, '(\\d+[MIDNSHP=X])', 1), p -> struct(cast(locate(right(p, 1), 'MIDNSHP=X') - 1 as int) as op, cast(substr(p, 1, length(p) - 1) as int) as len))")
    rows = rows.withColumn("cigar", cigar)
    used = F.aggregate(F.filter("cigar", lambda c: c["op"].isin(*ON_REFERENCE)), F.lit(0).cast("long"), lambda a, c: a + c["len"])
    refs = references.select(F.col("name").alias("_name"), "ref_id")
    out = rows.withColumn("alen", used).join(refs, "_name", "left")
    return out.select("ord", "query_name", "flag", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), "pos", "mapq", "cigar", "alen")


def count_reads(alignments: DataFrame) -> int:
    """Records, mapped or not."""
    return alignments.count()


def _opened(path: str):
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _is_block(head: bytes, at: int = 0) -> bool:
    return head[at : at + 4] == b"\x1f\x8b\x08\x04" and head[at + 12 : at + 14] == b"BC"


def next_block(file, start: int, end: int) -> int:
    """Offset of the first BGZF block from start on, below end; end if there is none.  A block is told by its header and that of its successor."""
    at, window = start, b""
    while at < end:
        file.seek(at)
        window = file.read(1 << 17)
        for found in re.finditer(rb"\x1f\x8b\x08\x04", window):
            k = found.start()
            if at + k >= end or k + 18 > len(window):
                break
            if not _is_block(window, k):
                continue
            file.seek(at + k + struct.unpack_from("<H", window, k + 16)[0] + 1)
            after = file.read(18)
            if not after or _is_block(after):
                return at + k
        at += max(1, len(window) - 17)
        if len(window) < 18:
            break
    return end


class Blocks:
    """Bytes of consecutive blocks from a file offset on."""

    def __init__(self, file, start: int) -> None:
        self.file, self.at, self.data, self.starts = file, start, bytearray(), []

    def need(self, n: int) -> bool:
        """Whether n bytes could be had."""
        while len(self.data) < n:
            self.file.seek(self.at)
            head = self.file.read(18)
            if len(head) < 18:
                return False
            if not _is_block(head):
                raise ValueError("no BGZF block")
            size = struct.unpack_from("<H", head, 16)[0] + 1
            self.file.seek(self.at)
            self.starts.append((len(self.data), self.at))
            self.data += zlib.decompress(self.file.read(size), 31)
            self.at += size
        return True


def bam_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """(header text, references, bytes of the uncompressed header)."""
    with _opened(path) as file:
        b = Blocks(file, 0)
        if not b.need(8) or b.data[:4] != b"BAM\1":
            raise ValueError("no BAM file")
        size = struct.unpack_from("<i", b.data, 4)[0]
        b.need(12 + size)
        text = b.data[8 : 8 + size].rstrip(b"\0").decode()
        count, at, refs = struct.unpack_from("<i", b.data, 8 + size)[0], 12 + size, []
        for _ in range(count):
            b.need(at + 4)
            n = struct.unpack_from("<i", b.data, at)[0]
            b.need(at + 8 + n)
            refs.append((b.data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", b.data, at + 4 + n)[0]))
            at += 8 + n
        return text, refs, at


def _plausible(b: Blocks, at: int, n_refs: int, depth: int = 4) -> bool:
    """Whether a chain of records can start at an offset."""
    for _ in range(depth):
        if not b.need(at + 36):
            return len(b.data) == at
        size, ref, pos, name, _, _, ops, _, seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", b.data, at)
        if not (-1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name > 0 and seq >= 0 and 32 + name + 4 * ops + (seq + 1) // 2 + seq <= size < 1 << 28):
            return False
        if not b.need(at + 36 + name) or b.data[at + 35 + name] != 0 or not all(33 <= c <= 126 for c in b.data[at + 36 : at + 35 + name]):
            return False
        at += 4 + size
    return True


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    skip: int
    n_refs: int
    number: int


class BamReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Range]:
        text, refs, header = bam_header(self.path)
        order = [p[3:] for line in text.split("\n") if line.startswith("@HD") for p in line.split("\t") if p.startswith("SO:")]
        if order != ["queryname"]:
            raise SortOrderError(f"the sort order must be queryname, not {order[0] if order else 'unknown'}")
        with _opened(self.path) as file:
            file.seek(0, 2)
            size = file.tell()
            b = Blocks(file, 0)
            b.need(header + 1)
        # the block in which the first record starts; each range looks for its own first block
        offset, first = [(o, f) for o, f in b.starts if o <= header][-1]
        cuts = [first, *range((first // RANGE_BYTES + 1) * RANGE_BYTES, size, RANGE_BYTES), size]
        return [Range(self.path, a, e, header - offset if a == first else 0, len(refs), k) for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with _opened(part.path) as file:
            b = Blocks(file, next_block(file, part.start, part.end) if part.number else part.start)
            if b.at >= part.end:
                return
            at = part.skip
            if part.number:
                if not b.need(1):
                    return
                at = next((i for i in range(1 << 28) if not b.need(i + 36) or _plausible(b, i, part.n_refs)), 0)
            block = count = 0
            while b.need(at + 4):
                # a record belongs to the range in which its first byte's block lies
                while block + 1 < len(b.starts) and b.starts[block + 1][0] <= at:
                    block += 1
                if b.starts[block][1] >= part.end:
                    break
                size = struct.unpack_from("<i", b.data, at)[0]
                if not b.need(at + 4 + size):
                    raise ValueError("a record is cut off")
                ref, pos, name, mapq, _, ops, flag, _, _, _, _ = struct.unpack_from("<iiBBHHHiiii", b.data, at + 4)
                own = b.data[at + 36 : at + 35 + name].decode()
                cigar = [{"op": c & 15, "len": c >> 4} for c in struct.unpack_from(f"<{ops}I", b.data, at + 36 + name)]
                rows.append(((part.number << 40) + count, own, flag, ref, pos, mapq, cigar, sum(c["len"] for c in cigar if c["op"] in ON_REFERENCE)))
                at, count = at + 4 + size, count + 1
                if at > 1 << 22:
                    del b.data[:at]
                    b.starts = [(o - at, f) for o, f in b.starts[block:]]
                    at = block = 0
                if len(rows) == 20_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())])), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ("ord", "query_name", "flag", "ref_id", "pos", "mapq", "cigar", "alen")])


class BamDataSource(DataSource):
    """spark.read.format("bam").load(file)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a BAM file sorted by query name; ord is the range's number and, in 40 bits, the record's number in it."""
    ship(spark).dataSource.register(BamDataSource)
    return spark.read.format("bam").load(path)


def read_bam_header(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, name, length)."""
    _, refs, _ = bam_header(path)
    return spark.createDataFrame([(i, n, length) for i, (n, length) in enumerate(refs)], "ref_id int, name string, length long")
