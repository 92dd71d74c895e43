"""Edge rules with values worked out by hand."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.config import MapConfig
from strandweave.errors import NoneAcceptedError, NoRemainingClustersError, TooFewError, UnknownEnzymeError, UnsupportedError
from strandweave.functions import numeric, prefix, sequence
from strandweave.operators import balance, bins, community, contacts, graph, masks, order_state, ordering, reports, subspace


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("length", "edges", "centers"), [(25, [0, 8, 16, 25], [-8.5, -0.5, 7.5]), (24, [0, 12, 24], [-6.0, 6.0]), (7, [0, 7], [0.0])])
def test_bins(spark, length, edges, centers):
    grouped = bins.grouped_bins(spark.createDataFrame([(0, length)], "seq_id int, length long"), 10)
    assert grouped.first().edges == edges
    assert [r.center for r in bins.bin_table(grouped).orderBy("bin_no").collect()] == centers


def test_zero_length(spark):
    with pytest.raises(Exception, match="has no length"):
        bins.grouped_bins(spark.createDataFrame([(0, 0)], "seq_id int, length long"), 10).collect()


def test_locate(spark):
    x = [0, 8, 9, 16, 17, 25, 30]
    df = spark.createDataFrame([(v, [0, 8, 16, 25]) for v in x], "x long, e array<long>")
    assert [r[0] for r in df.select(numeric.locate_bin("e", "x")).collect()] == [0, 0, 1, 1, 2, 2, 2]


@pytest.mark.parametrize(("length", "p", "tip"), [(100, 19, 0), (100, 20, None), (100, 80, None), (100, 81, 1), (40, 19, 0), (40, 20, None), (40, 21, 1)])
def test_tip(spark, length, p, tip):
    assert spark.range(1).select(numeric.tip_of(F.lit(p), F.lit(length), 20)).first()[0] == tip


def alignments(spark, records):
    cigar = [(0, 100)]
    return spark.createDataFrame([(n, o, f, r, p, q, cigar, 100) for o, (n, f, r, p, q) in enumerate(records)], "query_name string, ord int, flag int, ref_id int, pos long, mapq int, cigar array<struct<op:int,len:int>>, alen long")


def test_pairing(spark):
    a = alignments(spark, [(n, 0, 0, 0, 60) for n in "aaabcc"])
    pairs = contacts.paired(a.withColumn("at", F.col("ord") + 1), ["ord"])
    assert rows(pairs.select("a.at", "b.at")) == [(1, 2), (5, 6)]


def test_statuses(spark):
    seqs = spark.createDataFrame([(0, 0, "s", 100_000), (1, 1, "t", 100_000)], "seq_id int, ref_id int, name string, length long")
    records = [("excluded", 0, 0, 1, 60), ("excluded", 0, 9, 1, 60), ("poor", 0, 0, 1, 60), ("poor", 0, 1, 1, 5), ("short", 2, 0, 500, 60), ("short", 2, 0, 450, 60), ("middle", 0, 0, 50_000, 60), ("middle", 0, 1, 1, 60), ("good", 0x80, 1, 99_990, 60), ("good", 0x10, 0, 100, 60), ("lost", 0x4, 0, 1, 60), ("lost", 0, 0, 1, 60)]
    config = MapConfig(min_insert=100, min_mapq=10, tip_size=1000)
    got = contacts.classified(contacts.paired(contacts.informative(alignments(spark, records)), ["ord"]), seqs, config)
    assert {r.query_name: r.status for r in got.collect()} == {"excluded": "ref_excluded", "poor": "poor_match", "short": "short_insert", "middle": "not_tip", "good": "accepted"}
    good = got.where("query_name = 'good'").first()
    assert (good.i, good.j, good.pos_i, good.pos_j, good.k, good.l) == (0, 1, 200, 99_990, 0, 1)


def test_symmetry_and_signal(spark):
    upper = spark.createDataFrame([(0, 0, 2), (0, 1, 3)], "i int, j int, n long")
    seqs = spark.createDataFrame([(0, 10), (1, 10), (2, 10)], "seq_id int, length long")
    assert contacts.map_weight(upper).first()[0] == 8
    assert rows(masks.max_off_diagonal(upper, seqs)) == [(0, 3), (1, 3), (2, 0)]
    assert masks.is_hermitian(contacts.symmetric(upper)) and not masks.is_hermitian(upper)
    tips = spark.createDataFrame([(0, 1, 0, 1, 5), (2, 2, 0, 1, 4)], "i int, j int, k int, l int, n long")
    assert rows(contacts.symmetric_tips(tips)) == [(0, 1, 0, 1, 5), (1, 0, 1, 0, 5), (2, 2, 0, 1, 4)]
    assert rows(subspace.flattened(spark.createDataFrame([(1, 2, 0, 1, 9)], "i int, j int, k int, l int, n long"))) == [(2, 5, 9)]


@pytest.mark.parametrize(("lengths", "n50"), [([10, 8, 6, 4, 2], 8), ([5, 5], 5)])
def test_n50(spark, lengths, n50):
    df = spark.createDataFrame([(0, x) for x in lengths], "cl_id int, length long")
    assert reports.n50(df, ["cl_id"]).first().n50 == n50


def test_report_values(spark):
    df = spark.createDataFrame([(0, 0, 100, 40.0, None), (0, 1, 300, 60.0, None)], "cl_id int, seq_id int, length long, gc double, cov double")
    clusters = spark.createDataFrame([(0, "CL1", 400, 2)], "cl_id int, name string, extent long, size long")
    r = reports.cluster_report(df, clusters).first()
    assert (r.gc_expect, r.gc_mean, r.gc_median, r.gc_std, r.cov_mean) == (55.0, 50.0, 50.0, 10.0, None)


@pytest.mark.parametrize(("n", "first", "last"), [(9, "CL1", "CL9"), (10, "CL1", "CL10"), (11, "CL01", "CL11")])
def test_names(spark, n, first, last):
    got = [r.name for r in reports.named(spark.range(n).select(F.col("id").cast("int").alias("cl_id"))).orderBy("cl_id").collect()]
    assert (got[0], got[-1]) == (first, last)


def test_sites(spark):
    df = spark.createDataFrame([("GATCGATC",), ("ACGTACGTA",), ("",)], "s string")
    assert [r[0] for r in df.select(sequence.count_sites("s", ["MboI"])).collect()] == [2, 0, 0]
    # an enzyme that cuts beyond its site needs room for the cut, on either strand
    far = spark.createDataFrame([("CGTCTCA",), ("CGTCTC",), ("AGAGACG",), ("GAGACG",)], "s string")
    assert [r[0] for r in far.select(sequence.count_sites("s", ["BsmBI"])).collect()] == [1, 0, 1, 0]
    assert spark.createDataFrame([("TCAAGA",)], "s string").select(sequence.count_sites("s", ["MboI"], linear=False)).first()[0] == 1
    nine = spark.createDataFrame([("GATCAGATC",)], "s string")
    assert nine.select(sequence.tip_sites("s", ["MboI"], 6)).first()[0] == [1, 1]
    assert spark.createDataFrame([("GGCAN",)], "s string").select(sequence.gc_percent("s")).first()[0] == 60.0
    with pytest.raises(UnknownEnzymeError, match="HindIII"):
        sequence.enzyme("HinDIII")


@pytest.mark.parametrize(("legacy", "ids"), [(True, ["x.0_13", "x.13_27"]), (False, ["x.0_9", "x.9_18", "x.18_27"])])
def test_split(spark, legacy, ids):
    df = spark.createDataFrame([("x", "A" * 27)], "id string, seq string")
    assert [r.piece_id for r in sequence.split_sequences(df, 10, 0.333, legacy).orderBy("lo").collect()] == ids


def test_density_and_poisson(spark):
    got = spark.createDataFrame([(100.0,), (1000.0,), (500_000.0,)], "s double").select(numeric.contact_density("s")).collect()
    assert [r[0] for r in got] == pytest.approx([0.000961018742, 7.23266874e-05, 2e-08], rel=1e-6)
    got = spark.createDataFrame([(0, 1.5), (3, 2.0), (1, 1.0)], "n long, q double").select(numeric.poisson_term("n", "q")).collect()
    assert [r[0] for r in got] == pytest.approx([-1.5, -1.684640002, -0.918938533], abs=1e-8)


S = np.array([[9, 4, 2], [4, 9, 0], [2, 0, 9]])


@pytest.mark.parametrize(("method", "far"), [("inverse", [1, 255652815, 357913941]), ("linear", [1, 149130809, 357913941]), ("neglog", [1, 298261617, 357913941])])
def test_distances(method, far):
    d = ordering.similarity_distance(S, method, 1.2, 1).astype(int)
    assert [d[0, 1], d[0, 2], d[1, 2]] == far


def test_reciprocal():
    assert ordering.reciprocal_distance(np.array([[0, 3.0], [3, 0]])).tolist() == [[0, 1.01], [1.01, 0]]


@pytest.mark.parametrize(("m", "out"), [([[1, 1], [1, 1]], [[0.5, 0.5], [0.5, 0.5]]), ([[2, 1], [1, 3]], [[0.710102, 0.289898], [0.289898, 0.710102]]), ([[0, 2], [2, 4]], [[0, 0.5], [0.5, 0.5]])])
def test_balance(spark, m, out):
    cells = [(i, j, float(m[i][j])) for i in range(2) for j in range(i, 2) if m[i][j]]
    for cells_at_once in (100, 0):
        got, _ = balance.balanced(spark.createDataFrame(cells, "i int, j int, value double"), 1e-8, dense_cells=cells_at_once)
        assert {(r.i, r.j): r.value for r in got.collect()} == pytest.approx({(i, j): out[i][j] for i, j, _ in cells}, abs=1e-5)


@settings(max_examples=15, deadline=None)
@given(st.integers(2, 12), st.integers(0, 10_000))
def test_balance_property(n, seed):
    rng = np.random.default_rng(seed)
    m = rng.random((n, n)) * (rng.random((n, n)) < 0.6)
    m = m + m.T + np.eye(n)
    i, j = np.triu_indices(n)
    x = balance.solve(i, j, m[i, j], n, 1e-7, 1000)
    assert (m * np.outer(x, x)).sum(1) == pytest.approx(np.ones(n), abs=1e-6)


@settings(max_examples=12, deadline=None)
@given(st.integers(3, 7), st.integers(0, 10_000))
def test_tour_is_short(n, seed):
    rng = np.random.default_rng(seed)
    s = rng.random((n, n)) + 0.01
    d = ordering.similarity_distance(s + s.T, "inverse", 1.2)
    length = lambda t: sum(d[t[k - 1], t[k]] for k in range(n))
    path = ordering.tour(d, seed)
    assert sorted(path) == list(range(n))
    assert length(path) == pytest.approx(min(length((0, *p)) for p in itertools.permutations(range(1, n))), rel=1e-6)


def test_tips_stay_together():
    rng = np.random.default_rng(4)
    s = rng.random((12, 12))
    got = ordering.find_order(s + s.T, 1, tips=True)
    assert sorted(i for i, _ in got) == list(range(6)) and {o for _, o in got} <= {1, -1}
    with pytest.raises(TooFewError):
        ordering.find_order(np.ones((2, 2)))


def test_running_sum_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK", 8)
    df = spark.range(100).where("id % 3 <> 1").withColumn("v", F.col("id") * 2)
    got = rows(prefix.running_sum(df, "id", "v", "s").select("id", "s"))
    total = 0
    for i, s in got:
        assert s == total
        total += 2 * i
    assert [r[0] for r in prefix.dense_ids(df, "id", "k").orderBy("id").select("k").collect()] == list(range(len(got)))


def test_order_state(spark):
    seqs = spark.createDataFrame([(i, 10 * (i + 1)) for i in range(6)], "seq_id int, length long")
    state = order_state.initial(seqs)
    mask = seqs.select("seq_id", (F.col("seq_id") != 2).alias("accepted"))
    state = order_state.with_mask(state, mask)
    order = spark.createDataFrame([(s, r) for r, s in enumerate([5, 4, 3, 1, 0])], "seq_id int, rank int")
    state = order_state.with_order(state, order, implicit_excluded=True)
    assert [r.seq_id for r in state.orderBy("pos").collect()] == [5, 4, 3, 1, 0, 2]
    assert order_state.is_before(state, 5, 0)
    gap = order_state.intervening(state, spark.createDataFrame([(5, 1), (1, 5), (4, 3)], "a int, b int"))
    assert rows(gap) == [(1, 5, 90), (4, 3, 0), (5, 1, 90)]
    with pytest.raises(ValueError, match="exactly"):
        order_state.with_order(state, order.where("rank > 0"), implicit_excluded=True)
    assert [r.seq_id for r in order_state.masked(state, 4).orderBy("pos").collect()] == [5, 3, 1, 0, 4, 2]
    moved = order_state.shuffled(state, 3)
    assert sorted(r.pos for r in moved.collect()) == list(range(6)) and moved.where("not mask").first().pos == 5


def test_errors(spark):
    seqs = spark.createDataFrame([(0, 10)], "seq_id int, length long")
    signal = spark.createDataFrame([(0, 0)], "seq_id int, signal long")
    with pytest.raises(UnsupportedError):
        masks.acceptance(seqs, signal, 0, 0, max_fold=2.0)
    with pytest.raises(NoneAcceptedError):
        masks.accepted_ids(masks.acceptance(seqs, signal, 100, 0), check=True)
    clusters = spark.createDataFrame([(0, 5)], "cl_id int, extent long")
    order = spark.createDataFrame([(0, 0, 0, 1)], "cl_id int, rank int, seq_id int, ori int")
    with pytest.raises(NoRemainingClustersError):
        reports.enabled_clusters(order_state.initial(seqs), clusters, order, order.select("cl_id", "seq_id"), min_extent=100)


def cliques(spark, sizes, bridge=0.1):
    edges, at = [], 0
    for n in sizes:
        edges += [(a, b, 1.0) for a in range(at, at + n) for b in range(a + 1, at + n)]
        at += n
    starts = np.cumsum([0, *sizes[:-1]])
    edges += [(int(a), int(b), bridge) for a, b in zip(starts, starts[1:], strict=False)]
    return spark.createDataFrame(edges, "src long, dst long, weight double")


@pytest.mark.parametrize("method", ["louvain", "infomap", "mcl", "slm"])
def test_communities(spark, method):
    edges = cliques(spark, [5, 6, 4])
    more = {"inflation": 2.0} if method == "mcl" else {}
    found = {r.node: r.cl_id for r in community.clustered(edges, method, **more).collect()}
    assert len(found) == 15
    for group in (range(5), range(5, 11), range(11, 15)):
        assert len({found[v] for v in group}) == 1
    assert len(set(found.values())) == 3
    with pytest.raises(UnsupportedError):
        community.clustered(edges, "simap")


def test_modularity_by_hand():
    g = community.Graph(np.array([0, 1, 3, 4, 2]), np.array([1, 2, 4, 5, 3]), np.ones(5))
    label = [0, 0, 0, 1, 1, 1]
    assert community.modularity(g, label, 10.0) == pytest.approx(4 / 5 - 2 * (5 / 10) ** 2)
    one = community.code_length(g, [0] * 6, 10.0)
    assert one == pytest.approx(-sum(p * math.log2(p) for p in (0.1, 0.2, 0.2, 0.2, 0.2, 0.1)))


def test_graph_orders(spark):
    edges = cliques(spark, [4, 3])
    for found in (ordering.graphical_order(edges), ordering.hierarchical_order(edges), ordering.hierarchical_order(edges, "complete", False)):
        got = [r.node for r in found.orderBy("rank").collect()]
        assert sorted(got) == list(range(7))
    walk = ordering.heavy_first([(0, 1, 1.0), (0, 2, 3.0), (2, 3, 1.0)], 0)
    assert walk == [(0, 2), (2, 3), (0, 1)]
    c = np.random.default_rng(0).random((5, 5))
    a = ordering.assignment(c)
    assert sum(c[i, a[i]] for i in range(5)) == pytest.approx(min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5))))


def test_isolates_and_memberships(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 5.0), (3, 3, 1.0)], "src long, dst long, weight double")
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2)], "node long, cl_id int")
    nodes = part.select(F.col("node").alias("u"))
    assert rows(graph.with_isolates(part, nodes, edges, "drop")) == [(0, 0), (1, 0), (2, 1)]
    assert rows(graph.with_isolates(part, nodes, edges, "ragbag")) == [(0, 0), (1, 0), (2, 1), (3, 2)]
    assert rows(graph.soft_membership(edges, part, "simple")) == [(0, 0, 1.0), (1, 0, 1.0), (1, 1, 0.5), (2, 0, 0.5), (2, 1, 1.0), (3, 2, 1.0)]
    assert {r.node: r.component for r in graph.connected(edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_geometric_mean(spark):
    assert spark.createDataFrame([(10.0,), (20.0,), (40.0,)], "x double").agg(graph.geometric_mean("x")).first()[0] == pytest.approx(20)


def test_extents_to_sequences(spark):
    upper = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 1)], "bi long, bj long, n long")
    table = spark.createDataFrame([(0, 0), (1, 1)], "bin_id long, seq_id int")
    assert rows(subspace.extents_to_sequences(upper, table)) == [(0, 0, 1), (0, 1, 2), (1, 1, 1)]
    assert rows(subspace.extents_to_sequences(upper, table, legacy=True)) == [(0, 0, 1), (0, 1, 2), (1, 1, 3)]
