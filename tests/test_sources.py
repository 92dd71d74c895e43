"""Files in and out, whole maps, streams and the command line."""

import bz2
import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandweave.config import MapConfig
from strandweave.plans import cli
from strandweave.plans.contact_map import ContactMap
from strandweave.sources import alignments, clusters, fasta, sinks
from strandweave.streaming import ingest

FASTA = ">s1 first multi=2.5 x\nGATCGATC\nAA\n>s2\nGGCC\n>s3 third\n\nACGT>T\n"


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2"])
def test_fasta(spark, tmp_path, suffix):
    path = tmp_path / f"x.fa{suffix}"
    data = FASTA.encode()
    path.write_bytes({"": bytes, ".gz": gzip.compress, ".bz2": bz2.compress}[suffix](data))
    got = sorted((r.id, r.description, r.seq) for r in fasta.read_fasta(spark, str(path)).collect())
    assert got == [("s1", "s1 first multi=2.5 x", "GATCGATCAA"), ("s2", "s2", "GGCC"), ("s3", "s3 third", "ACGT>T")]
    assert fasta.count_records(spark, str(path)) == 3
    counted = fasta.counted_sequences(fasta.read_fasta(spark, str(path)), ["MboI"], 5)
    assert sorted(tuple(r) for r in counted.collect()) == [("s1", 10, 2), ("s3", 6, 0)]
    assert sinks.open_input(str(path)).read() == FASTA


HEADER = "@HD\tVN:1.6\tSO:queryname\n@SQ\tSN:s1\tLN:2000\n@SQ\tSN:s2\tLN:3000\n@SQ\tSN:s3\tLN:2500\n"
READS = [("r1", 65, "s1", 11, 60, "50M"), ("r1", 129, "s2", 21, 60, "10S40M"), ("r2", 65, "s1", 5, 60, "50M"), ("r2", 145, "s2", 100, 60, "40M10S"), ("r3", 65, "s3", 7, 60, "20M5D30M"), ("r3", 129, "s1", 9, 3, "50M"), ("r4", 65, "s2", 1, 60, "50M"), ("r4", 129, "s3", 1, 60, "50M"), ("r5", 4, "*", 0, 0, "*")]


def sam(tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(HEADER + "".join(f"{n}\t{f}\t{r}\t{p}\t{q}\t{c}\t*\t0\t0\t*\t*\n" for n, f, r, p, q, c in READS))
    return str(path)


def bgzf(data, size=200):
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam(tmp_path, copies=1, text=HEADER):
    names = ["s1", "s2", "s3"]
    data = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 3)
    for n, length in zip(names, (2000, 3000, 2500), strict=True):
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
    for k in range(copies):
        for n, f, r, p, q, c in READS:
            import re

            ops = [(int(x) << 4) | "MIDNSHP=X".index(o) for x, o in re.findall(r"(\d+)([MIDNSHP=X])", c)]
            name = f"{n}.{k}".encode() + b"\0"
            body = struct.pack("<iiBBHHHiiii", names.index(r) if r != "*" else -1, p - 1, len(name), q, 0, len(ops), f, 0, -1, -1, 0) + name + b"".join(struct.pack("<I", o) for o in ops)
            data += struct.pack("<i", len(body)) + body
    path = tmp_path / "x.bam"
    path.write_bytes(bgzf(data))
    return str(path)


def test_sam_and_bam(spark, tmp_path, monkeypatch):
    refs = alignments.read_sam_header(spark, sam(tmp_path))
    assert sorted(tuple(r) for r in refs.collect()) == [(0, "s1", 2000), (1, "s2", 3000), (2, "s3", 2500)]
    text = alignments.read_sam(spark, sam(tmp_path), refs)
    assert alignments.count_reads(text) == len(READS)
    key = lambda r: (r.query_name.split(".")[0], r.flag, r.ref_id, r.pos, r.mapq, [tuple(c) for c in r.cigar], r.alen)
    one = alignments.read_bam(spark, bam(tmp_path))
    assert [key(r) for r in one.orderBy("ord").collect()] == [key(r) for r in text.orderBy("ord").collect()]
    assert sorted(tuple(r) for r in alignments.read_bam_header(spark, bam(tmp_path)).collect()) == sorted(tuple(r) for r in refs.collect())
    # many ranges give every record once
    path = bam(tmp_path, 300)
    monkeypatch.setattr(alignments, "RANGE_BYTES", 2000)
    reader = alignments.BamReader(path)
    parts = reader.partitions()
    assert len(parts) > 5
    got = [(r["query_name"], r["flag"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(f"{n}.{k}", f) for k in range(300) for n, f, *_ in READS]
    unsorted = bam(tmp_path, text=HEADER.replace("queryname", "coordinate"))
    with pytest.raises(OSError, match="queryname"):
        alignments.BamReader(unsorted).partitions()


def test_whole_map(spark, tmp_path):
    refs = alignments.read_sam_header(spark, sam(tmp_path))
    reads = alignments.read_sam(spark, sam(tmp_path), refs)
    path = tmp_path / "g.fa"
    path.write_text("".join(f">{n}\n{'GATC' * (length // 4)}\n" for n, length in (("s1", 2000), ("s2", 3000), ("s3", 2500))))
    seqs = fasta.counted_sequences(fasta.read_fasta(spark, str(path)), ["MboI"], tip=500)
    config = MapConfig(enzymes=("MboI",), min_mapq=10, bin_size=1000, min_signal=1)
    m = ContactMap.build(reads, refs, seqs, config, ["ord"])
    assert {r.status: r.n for r in m.statuses().collect()} == {"accepted": 3, "poor_match": 1}
    assert m.weight() == 6 and not m.is_empty()
    assert m.appended(m).weight() == 12
    assert sorted(tuple(r)[:2] for r in m.graph(bisto=False).collect()) == [(0, 1), (1, 2)]
    assert m.extent_map(bisto=False).count() == 2
    found, members = m.clusters("louvain")
    assert found.agg(F.sum("size")).first()[0] == members.count()
    tips = ContactMap.build(reads, refs, seqs, MapConfig(min_mapq=10, tip_size=500, bin_size=1000, min_signal=1), ["ord"])
    flat, ids = tips.subspace(tips.processed(bisto=False), flatten=True)
    assert ids.count() == 3 and flat.agg(F.max("j")).first()[0] <= 5
    with pytest.raises(ValueError, match="not both"):
        tips.subspace(tips.processed(bisto=False), marginalise=True, flatten=True)
    with pytest.raises(ValueError, match="can't be added"):
        m.appended(tips)
    sinks.save_bundle({"sequences": m.sequences, "contacts": m.contacts}, {"bin_size": 1000}, str(tmp_path / "bundle"))
    tables, config = sinks.load_bundle(spark, str(tmp_path / "bundle"))
    assert config == {"bin_size": 1000} and tables["contacts"].count() == 2


def test_cluster_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert sorted(tuple(r) for r in clusters.read_mcl(spark, put("m", "3 1\n2\n\n9\n")).collect()) == [(0, 1), (0, 3), (1, 2)]
    assert sorted(tuple(r) for r in clusters.read_table(spark, put("t", "0 5\n1\t5\n2  6\n")).collect()) == [(5, 0), (5, 1), (6, 2)]
    assert sorted(tuple(r) for r in clusters.read_table(spark, put("u", "4\n4\n7\n"), None).collect()) == [(4, 0), (4, 1), (7, 2)]
    tree = '# made\n1:1 0.1 "a" 7\n2:1 0.2 "b" 1\n2:2 0.1 "c" 2\n'
    assert sorted(tuple(r) for r in clusters.read_tree(spark, put("x", tree)).collect()) == [(0, 1), (0, 2), (1, 7)]
    head, tour = clusters.read_tour(spark, put("y", "NAME : z\nDIMENSION : 3\nTOUR_SECTION\n2\n3\n1\n-1\nEOF\n"))
    assert head == {"NAME": "z", "DIMENSION": 3} and [r.node for r in tour.orderBy("rank").collect()] == [1, 2, 0]
    edges = clusters.read_edges(spark, put("e", "0 1 2.5\n1 2 {'weight': 0.5}\n2 3\n"))
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1, 2.5), (1, 2, 0.5), (2, 3, 1.0)]
    gml = '<graphml><key id="d0" for="edge" attr.name="weight" attr.type="double"/><graph><node id="a"/><edge source="a" target="b"><data key="d0">2.0</data></edge></graph></graphml>'
    assert [tuple(r) for r in clusters.read_graphml(spark, put("g.xml", gml)).collect()] == [("a", "b", 2.0)]
    report = {"seq_info": {"s1": {"coverage": 2.5, "sites": 3, "length": 10}, "s2": {"coverage": 1.0, "sites": [1, 2], "length": 20}}}
    want = [("s1", 2.5, [3], 10), ("s2", 1.0, [1, 2], 20)]
    assert sorted(tuple(r) for r in clusters.read_report(spark, put("r.json", json.dumps(report))).collect()) == want
    yaml = "seq_info:\n  s1:\n    coverage: 2.5\n    length: 10\n    sites: 3\n  s2:\n    coverage: 1.0\n    length: 20\n    sites:\n    - 1\n    - 2\n"
    assert sorted(tuple(r) for r in clusters.parse_yaml_report(spark, put("r.yml", yaml)).collect()) == want


def test_sinks(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "a", 4), (1, "b", 6), (2, "c", 4)], "seq_id int, name string, length long")
    members = spark.createDataFrame([(0, 1), (0, 0)], "cl_id int, seq_id int")
    found = spark.createDataFrame([(0, "CL1", 10, 2)], "cl_id int, name string, extent long, size long")
    genome = spark.createDataFrame([("a", "", "ACGT"), ("b", "", "AACCGG"), ("c", "", "TTTT")], "id string, description string, seq string")
    sinks.write_mcl(members, seqs, str(tmp_path / "mcl"))
    assert [r.value for r in spark.read.text(str(tmp_path / "mcl")).collect()] == ["a b", "c"]
    order = spark.createDataFrame([(0, 0, 1, -1), (0, 1, 0, 1)], "cl_id int, rank int, seq_id int, ori int")
    rows = sinks.cluster_sequences(found, members, seqs, genome, order)
    paths = sinks.write_fasta(rows, str(tmp_path / "fa"), ".ordered.fna")
    assert open(paths[0]).read() == ">CL1_1 contig:b ori:REVERSE length:6\nCCGGTT\n>CL1_2 contig:a ori:FORWARD length:4\nACGT\n"
    with pytest.raises(FileExistsError):
        sinks.write_fasta(rows, str(tmp_path / "fa"), ".ordered.fna")
    plain = sinks.cluster_sequences(found, members, seqs, genome)
    assert [(r.id, r.description) for r in plain.orderBy("n").collect()] == [("CL1_1", "contig:a ori:UNKNOWN length:4"), ("CL1_2", "contig:b ori:UNKNOWN length:6")]
    assert sinks.cluster_sequences(found, members, seqs, genome, min_extent=11).isEmpty()
    sinks.write_fasta_text(plain, str(tmp_path / "text"))
    assert (tmp_path / "text" / "name=CL1").is_dir()
    edges = spark.createDataFrame([(0, 1, 2.5)], "src long, dst long, weight double")
    sinks.write_edges(edges, str(tmp_path / "edges"))
    assert [tuple(r) for r in clusters.read_edges(spark, str(tmp_path / "edges")).collect()] == [(0, 1, 2.5)]
    sinks.write_copies(edges, [str(tmp_path / "c1"), str(tmp_path / "c2")], "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c2")).count() == 1
    with sinks.open_output(str(tmp_path / "o.gz"), compress="gzip") as out:
        out.write("x")
    with sinks.open_output(str(tmp_path / "o.gz"), append=True, compress="gzip") as out:
        out.write("y")
    assert sinks.open_input(str(tmp_path / "o.gz")).read() == "xy"
    assert sinks.load_object(sinks.dump_object({"a": [1]})) == {"a": [1]}
    sinks.write_tour_problem([[0, 1, 2], [1, 0, 3], [2, 3, 0]], str(tmp_path / "p"), [(0, 1)])
    assert "1 2\n-1\n" in (tmp_path / "p.dat").read_text()


def test_stream(spark, tmp_path):
    refs = alignments.read_sam_header(spark, sam(tmp_path))
    reads = alignments.read_sam(spark, sam(tmp_path), refs)
    seqs = refs.select(F.col("ref_id").alias("seq_id"), "ref_id", "name", "length")
    config = MapConfig(min_mapq=10)
    for k in range(2):
        reads.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, seqs, config, ["ord"], str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        got = {(r.i, r.j): r.n for r in ingest.contacts(spark, str(tmp_path / "out")).collect()}
        assert got == {(0, 1): 2 * (k + 1), (1, 2): k + 1}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "e").write_text("0 1 1\n1 2 1\n0 2 1\n3 4 1\n5 5 1\n")
    cli.main(["--ragbag", str(tmp_path / "e"), str(tmp_path / "out")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0 1 2", "3 4", "5"]
    cli.main(["--ofmt", "graphml", "--otype", "simple", str(tmp_path / "e"), str(tmp_path / "xml")])
    assert "nodes=6" in capsys.readouterr().out


def test_lines_of_a_file_in_many_parts(spark, tmp_path):
    """Numbers, reports and the end at a blank line don't depend on where a file is cut."""
    lines = [f" {k} {'x' * (k * 7 % 90)} " for k in range(500)]
    (tmp_path / "cut.txt").write_bytes("\r\n".join([*lines, "\t", "beyond"]).encode())
    report = "seq_info:\n" + "".join(f"  s{k}:\n    coverage: {k}.5\n    length: {k}\n    sites:\n    - {k}\n    - {k + 1}\n" for k in range(200))
    (tmp_path / "cut.yml").write_text(report)
    (tmp_path / "none.txt").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path / "cut.txt")).rdd.getNumPartitions() > 8
        got = clusters.numbered_lines(spark, str(tmp_path / "cut.txt")).collect()
        assert sorted((r.n, r.line) for r in got) == [(k, x.strip()) for k, x in enumerate(lines)]
        every = clusters.numbered_lines(spark, str(tmp_path / "cut.txt"), stop_at_blank=False)
        assert every.where("n >= 500").orderBy("n").collect() == [(500, ""), (501, "beyond")]
        rows = clusters.parse_yaml_report(spark, str(tmp_path / "cut.yml")).collect()
        assert sorted((r.name, r.coverage, r.sites, r.length) for r in rows) == sorted((f"s{k}", k + 0.5, [k, k + 1], k) for k in range(200))
        assert clusters.numbered_lines(spark, str(tmp_path / "none.txt")).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
