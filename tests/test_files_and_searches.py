"""Large and odd files, documents that other programs read, ranks, and searches against exhaustive ones."""

import itertools
import json
import random
import tracemalloc
import xml.etree.ElementTree as ET
from pathlib import Path

import numpy as np
import pytest

import strandweave
from strandweave.errors import UnsupportedError
from strandweave.functions.prefix import ranked
from strandweave.operators import balance, community, ordering
from strandweave.plans import cli
from strandweave.sources import alignments, fasta, sinks
from tests.test_sources import READS, bam


def test_many_blocks_in_one_range(tmp_path, monkeypatch):
    """Records of thousands of blocks, in one range and in ranges that begin anywhere in a block."""
    path = bam(tmp_path, 3000)
    want = [(f"{n}.{k}", f) for k in range(3000) for n, f, *_ in READS]
    for size in (1 << 30, 50_000, 7_777):
        monkeypatch.setattr(alignments, "RANGE_BYTES", size)
        reader = alignments.BamReader(path)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["query_name"], r["flag"]) for r in rows] == want
        assert all(a["ord"] < b["ord"] for a, b in itertools.pairwise(rows))


def test_ranks_of_any_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9), rng.choice(["a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x int, s string").repartition(7)
    got = {r.id: r.rank for r in ranked(df, [("x", False), ("s", True), ("id", True)], "rank").collect()}
    want = sorted(rows, key=lambda r: (-r[1], (r[2] is not None, r[2] or ""), r[0]))
    assert [got[r[0]] for r in want] == list(range(500))
    assert ranked(df.limit(0), [("x", True)], "rank").count() == 0


def test_graphml_is_a_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "GRAPH_ROWS", 4)
    part = spark.createDataFrame([(n, n % 2) for n in range(20)], "node long, cl_id int")
    sinks.write_graphml(part, str(tmp_path / "g"))
    edges, nodes = set(), set()
    for file in Path(tmp_path / "g").glob("part-*"):
        root = ET.fromstring(file.read_text())
        assert root.tag.endswith("graphml")
        for graph in root:
            own = {x.get("id") for x in graph if x.tag.endswith("node")}
            found = {(x.get("source"), x.get("target")) for x in graph if x.tag.endswith("edge")}
            assert {e for pair in found for e in pair} == own and graph.get("edgedefault") == "directed"
            edges |= found
            nodes |= own
    assert edges == {(f"c{n % 2}", str(n)) for n in range(20)} and len(nodes) == 22


def test_names_as_node_ids(spark, tmp_path):
    keys = '<key id="w" for="edge" attr.name="weight" attr.type="double"/>'
    edge = lambda a, b: f'<edge source="{a}" target="{b}"><data key="w">1.0</data></edge>'
    (tmp_path / "g.xml").write_text(f"<graphml>{keys}<graph>{edge('ann', 'bob')}{edge('bob', 'cy')}{edge('cy', 'ann')}{edge('x1', 'x2')}</graph></graphml>")
    cli.main(["--ifmt", "graphml", str(tmp_path / "g.xml"), str(tmp_path / "out")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["ann bob cy", "x1 x2"]


def test_yaml(tmp_path):
    data = {"seq_info": {"a: b": {"coverage": 1.5, "sites": [1, 2], "none": None, "empty": {}}}, "list": [{"x": 1, "y": [True, "z"]}, []]}
    text = sinks.dump_object(data, "yaml")
    assert text != json.dumps(data) and text.startswith('"seq_info":\n  "a: b":\n')
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load(text) == data == sinks.load_object(text, "yaml")


def test_indexed_sequences(spark):
    df = spark.createDataFrame([("a", "a x", "ACGT"), ("b", "b", "GG")], "id string, description string, seq string")
    index = fasta.IndexedSequences(df)
    assert len(index) == 2 and sorted(index) == ["a", "b"] and index["b"].seq == "GG"
    with pytest.raises(KeyError):
        index["c"]
    assert strandweave.version_stamp().endswith(strandweave.__version__)


def test_short_tours_are_the_shortest():
    rng = np.random.default_rng(2)
    for n in range(2, 8):
        d = rng.random((n, n))
        d = d + d.T
        best = min(ordering.closed_length(d, [0, *p]) for p in itertools.permutations(range(1, n)))
        assert abs(ordering.closed_length(d, ordering.tour(d)) - best) < 1e-9
    d = rng.random((8, 8))
    d = d + d.T
    ways = ([x for k, t in zip((0, *p), (0, *ts), strict=True) for x in ((2 * k, 2 * k + 1) if not t else (2 * k + 1, 2 * k))] for p in itertools.permutations(range(1, 4)) for ts in itertools.product((0, 1), repeat=3))
    got = ordering.tour(d, fixed=[(i, i + 1) for i in range(0, 8, 2)])
    assert abs(ordering.closed_length(d, got) - min(ordering.closed_length(d, w) for w in ways)) < 1e-9


def test_leaf_order_is_the_best_of_the_tree():
    rows = np.random.default_rng(5).random((7, 4))
    merges = ordering.linkage(rows)
    sets = {i: {i} for i in range(7)}
    for k, (a, b, _) in enumerate(merges):
        sets[7 + k] = sets[a] | sets[b]
    d = np.abs(rows[:, None] - rows[None]).sum(2)
    cost = lambda p: sum(d[a, b] for a, b in itertools.pairwise(p))
    allowed = (p for p in itertools.permutations(range(7)) if all(max(map(p.index, s)) - min(map(p.index, s)) + 1 == len(s) for s in sets.values()))
    assert abs(cost(ordering.leaf_order(rows, merges)) - min(map(cost, allowed))) < 1e-9


def test_depth_first_takes_the_heaviest():
    edges = [(0, 1, 5.0), (0, 2, 9.0), (2, 3, 1.0), (1, 3, 4.0), (2, 4, 1.0), (7, 8, 1.0)]
    assert ordering.heavy_first(edges) == [(0, 2), (2, 3), (3, 1), (2, 4), (7, 8)]
    assert ordering.heavy_first(edges, 3) == [(3, 1), (1, 0), (0, 2), (2, 4)]


def test_whole_graphs_have_a_limit(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WHOLE_NODES", 3)
    edges = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    with pytest.raises(UnsupportedError):
        ordering.hierarchical_order(edges)


def test_smart_moving_beats_or_meets_louvain():
    rng = np.random.default_rng(3)
    src, dst = rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    keep = src < dst
    graph = community.Graph(src[keep], dst[keep], rng.random(keep.sum()))
    total = sum(graph.degrees())
    value = lambda label: community.modularity(graph, label, total, 2.0)
    assert value(community.smart_labels(graph, total)) >= value(community.louvain_labels(graph, total, 2.0)) - 1e-9


def test_banded_map_balances_alike(spark):
    cells = [(i, j, float(1 + (7 * i + j) % 5) * 10 ** ((i * j) % 3)) for i in range(40) for j in (i, i + 1, i + 2) if j < 40 and not (i == j and i % 6 == 0)]
    df = spark.createDataFrame(cells, "i int, j int, value double")
    one, other = ({r.seq_id: r.x for r in balance.scale_factors(df, 1e-8, dense_cells=n).collect()} for n in (10**6, 0))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 for k in one)


def test_cliques_are_their_pairs(spark):
    """Degrees, modularity, code length, merged nodes and links of moving nodes: the same with cliques as with each of their pairs listed."""
    for seed in range(10):
        rng = np.random.default_rng(seed)
        src, dst = np.sort(rng.integers(0, 40, (2, 60)), axis=0)
        members = [(g, u, float(rng.choice([0.05, 0.3, 1, 3]))) for g in range(6) for u in rng.choice(40, rng.integers(1, 12), replace=False)]
        members = [(g, u, next(w for h, _, w in members if h == g)) for g, u, _ in members]
        listed = [(a, b, w) for (g, a, w), (h, b, _) in itertools.combinations(members, 2) if g == h] + [(u, u, 0.0) for _, u, _ in members]
        w = rng.random(60)
        one = community.Graph(src, dst, w, tuple(map(np.array, zip(*members, strict=True))))
        other = community.Graph(*(np.concatenate((x, np.array(y))) for x, y in zip((src, dst, w), zip(*listed, strict=True), strict=True)))
        total = float(other.degrees().sum())
        label = rng.integers(0, 8, one.n).tolist()
        for a, b in ((one, other), (one.merged(label)[0], other.merged(label)[0]), (one.inside(label), other.inside(label))):
            now = rng.integers(0, 5, a.n).tolist()
            assert np.allclose(a.degrees(), b.degrees()) and np.allclose(a.loops, b.loops)
            assert community.modularity(a, now, total) == pytest.approx(community.modularity(b, now, total))
            assert community.code_length(a, now, total) == pytest.approx(community.code_length(b, now, total))
            left, right = community.Links(a, list(now)), community.Links(b, list(now))
            for u in rng.integers(0, a.n, 40).tolist():
                x, y = left.of(u), right.of(u)
                assert all(abs(x.get(c, 0.0) - y.get(c, 0.0)) < 1e-9 for c in x | y)
                to = int(rng.choice(sorted(x)))
                left.move(u, to)
                right.move(u, to)


def test_orders_with_cliques_are_those_with_their_pairs(spark):
    edges = [(0, 1, 0.5), (2, 3, 0.1), (3, 8, 0.2), (9, 12, 0.1), (5, 6, 7.0), (13, 13, 1.0)]
    members = [(g, n, w) for g, nodes, w in ((1, range(4), 1.0), (2, range(4, 9), 2.0), (3, range(9, 12), 1.5), (4, (0, 4, 9, 12), 0.05)) for n in nodes]
    pairs = [(a, b, w) for (g, a, w), (h, b, _) in itertools.combinations(members, 2) if g == h]
    some = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = ordering.graphical_order(some, cliques=spark.createDataFrame(members, "clique long, node long, weight double"))
    want = ordering.graphical_order(spark.createDataFrame(edges + pairs, some.schema))
    rows = sorted((r.rank, r.node) for r in got.collect())
    assert rows == sorted((r.rank, r.node) for r in want.collect()) and [r for r, _ in rows] == list(range(14))


def test_graphs_take_few_bytes_an_edge():
    """A component is flat arrays, not dictionaries of numbers: under 100 bytes an edge while it is made, and under 30 afterwards."""
    rng = np.random.default_rng(0)
    src, dst = np.sort(rng.integers(0, 2_500, (2, 100_000)), axis=0)
    weight = np.ones(len(src))
    tracemalloc.start()
    graph = community.Graph(src, dst, weight)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert graph.degrees().sum() == 200_000 and held < 30 * len(src) and most < 100 * len(src)
