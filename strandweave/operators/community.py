"""Community detection: Louvain with a resolution, smart local moving, a two-level map equation, and Markov clustering.

Louvain, smart moving and the map equation work on whole connected components, one task for each (and for each start or trial), with the
whole graph's weight; Markov clustering is DataFrame operations throughout.  simap isn't offered: its criterion isn't public.

A graph is edges (src, dst, weight) and, if given, cliques (clique, node, weight): each two nodes of a clique are linked with its weight,
beside the edges.  The pairs, whose number is the square of a clique's size, are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..errors import UnsupportedError
from ..functions.prefix import dense_ids
from ..tables import written
from .graph import both_ways, connected, stars


class Net:
    """Links between nodes 0, 1, 2, ... in flat arrays: each pair from both ends, by node; loops; and cliques, in which nodes with shares x and y are
    linked with weight * x * y.  Merging nodes adds up their shares, so cliques stay cliques.  Node numbers have 32 bits."""

    def __init__(self, loops: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], shares: tuple[np.ndarray, np.ndarray, np.ndarray], heavy: np.ndarray) -> None:
        """pairs: (a, b, weight), a <> b, repeats allowed; shares: (node, clique, x), each node once in a clique; heavy: cliques' weights."""
        n = self.n = len(loops)
        self.loops = loops
        a, b, w = pairs
        del pairs
        key = np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b)
        del a, b
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        w = np.add.reduceat(w[order], new) if len(new) else np.zeros(0)
        key = key[new]
        low, high = (key // max(n, 1)).astype(np.int32), (key % max(n, 1)).astype(np.int32)
        del key, order, new
        # those of less number come first, by number, as the pairs are by low and high
        ends = np.concatenate((high, low))
        order = np.argsort(ends, kind="stable").astype(np.int32)
        self.start = np.searchsorted(ends, np.arange(n + 1), sorter=order)
        del ends
        self.to = np.concatenate((low, high))[order]
        order %= max(len(w), 1)
        self.link = w[order]
        del order
        node, clique, x = shares
        kept = np.bincount(clique, minlength=len(heavy))[clique] > 1
        names, clique = np.unique(clique[kept], return_inverse=True)
        order = np.lexsort((clique, node[kept]))
        self.heavy, self.member, self.clique, self.share = heavy[names], node[kept][order], clique[order], x[kept][order]
        self.member_start = np.searchsorted(self.member, np.arange(n + 1))

    @property
    def origin(self) -> np.ndarray:
        """The node of each link."""
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.start))

    def strengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each node's links to others: by edges, and of each share."""
        whole = np.bincount(self.clique, self.share, len(self.heavy))
        return np.bincount(self.origin, self.link, self.n), self.heavy[self.clique] * self.share * (whole[self.clique] - self.share)

    def outward(self) -> np.ndarray:
        """Weight of each node's links to others."""
        edges, cliques = self.strengths()
        return edges + np.bincount(self.member, cliques, self.n)

    def degrees(self) -> np.ndarray:
        return self.outward() + 2 * self.loops

    def first(self) -> list[int]:
        """Communities to begin with: nodes with over half of their weight in a clique are in the clique's (so no member goes through all others), the others single."""
        edges, cliques = self.strengths()
        main = cliques > (edges + np.bincount(self.member, cliques, self.n))[self.member] / 2
        label = np.arange(self.n)
        lead = np.full(len(self.heavy), self.n)
        np.minimum.at(lead, self.clique[main], self.member[main])
        label[self.member[main]] = lead[self.clique[main]]
        return label.tolist()

    def within(self, label: np.ndarray) -> np.ndarray:
        """Twice the weight of links between different nodes of each community, by label."""
        small = label.astype(np.int32)
        own = small[self.origin]
        same = own == small[self.to]
        out = np.bincount(own[same], self.link[same], label.max(initial=-1) + 1)
        by, x, squares = self._held(label)
        return out + np.bincount(by[1], self.heavy[by[0]] * (x * x - squares), len(out))

    def _held(self, label: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """((clique, label), sum of shares, sum of their squares) of each clique's part in a community."""
        m = int(label.max(initial=0)) + 1
        key, at = np.unique(self.clique.astype(np.int64) * m + label[self.member], return_inverse=True)
        return (key // m, key % m), np.bincount(at, self.share, len(key)), np.bincount(at, self.share**2, len(key))

    def held(self, label: np.ndarray) -> list[dict[int, float]]:
        """Shares of each community in each clique."""
        out: list[dict[int, float]] = [{} for _ in self.heavy]
        (clique, c), x, _ = self._held(label)
        for g, k, y in zip(clique.tolist(), c.tolist(), x.tolist(), strict=True):
            out[g][k] = y
        return out

    def merged(self, label: list[int]) -> tuple[Net, list[int]]:
        """Communities as nodes, in the order of their labels; and the new node of each old one."""
        names, new = np.unique(np.asarray(label, np.int64), return_inverse=True)
        loops = np.bincount(new, self.loops, len(names)) + self.within(new) / 2
        small, origin = new.astype(np.int32), self.origin
        a, b = small[origin], small[self.to]
        kept = (origin < self.to) & (a != b)
        del origin
        (clique, node), x, _ = self._held(new)
        return Net(loops, (a[kept], b[kept], self.link[kept]), (node, clique, x), self.heavy), new.tolist()

    def inside(self, label: list[int]) -> Net:
        """The links within communities."""
        label = np.asarray(label, np.int64)
        origin = self.origin
        kept = (origin < self.to) & (label[origin] == label[self.to])
        names, part = np.unique(self.clique * (self.n + 1) + label[self.member], return_inverse=True)
        return Net(self.loops, (origin[kept], self.to[kept], self.link[kept]), (self.member, part, self.share), self.heavy[names // (self.n + 1)])


class Graph(Net):
    """One component: edges, and cliques as (clique, node, weight)."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, cliques: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        clique, node, heavy = cliques or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.nodes = np.unique(np.concatenate([np.unique(x) for x in (src, dst, node)]))
        a, b, node = (np.searchsorted(self.nodes, x).astype(np.int32) for x in (src, dst, node))
        own = a == b
        _, first, clique = np.unique(clique, return_index=True, return_inverse=True)
        super().__init__(np.bincount(a[own], weight[own], len(self.nodes)), (a[~own], b[~own], weight[~own]), (node, clique, np.ones(len(node))), heavy[first])


class Links:
    """Weights of a node's links to communities, while nodes move."""

    def __init__(self, net: Net, label: list[int]) -> None:
        self.net, self.label = net, label
        # views give Python numbers without a list of them all
        self.start, self.to, self.link = memoryview(net.start), memoryview(net.to), memoryview(net.link)
        self.member_start, self.clique, self.share = memoryview(net.member_start), memoryview(net.clique), memoryview(net.share)
        self.heavy = net.heavy.tolist()
        now = np.asarray(label, np.int64)
        self.held = net.held(now)
        self.cliques = len(self.heavy) > 0
        size = np.bincount(now, minlength=net.n)
        self.size, self.free = size.tolist(), np.flatnonzero(size == 0)[::-1].tolist()
        order = np.argsort(net.clique, kind="stable")
        self.members, self.members_start = net.member[order], np.searchsorted(net.clique[order], np.arange(len(self.heavy) + 1))
        self.changed: set[int] = set()

    def near(self, u: int) -> list[int]:
        """Nodes at the other ends of u's edges."""
        return self.to[self.start[u] : self.start[u + 1]].tolist()

    def of(self, u: int) -> dict[int, float]:
        """Weight of u's links to each neighbouring community and to its own; with cliques, an empty community too, for a node that isn't alone."""
        label = self.label
        own = label[u]
        out = {own: 0.0}
        s, e = self.start[u], self.start[u + 1]
        for v, w in zip(self.to[s:e].tolist(), self.link[s:e].tolist(), strict=True):
            c = label[v]
            out[c] = out.get(c, 0.0) + w
        if self.cliques:
            for k in range(self.member_start[u], self.member_start[u + 1]):
                g, x = self.clique[k], self.share[k]
                f = self.heavy[g] * x
                for c, y in self.held[g].items():
                    if c == own:
                        y -= x
                    out[c] = out.get(c, 0.0) + f * y
            if self.free and self.size[own] > 1:
                out[self.free[-1]] = 0.0
        return out

    def move(self, u: int, to: int) -> None:
        own = self.label[u]
        self.label[u] = to
        if not self.cliques:
            return
        self.size[own] -= 1
        self.size[to] += 1
        if self.free and self.free[-1] == to:
            self.free.pop()
        if not self.size[own]:
            self.free.append(own)
        for k in range(self.member_start[u], self.member_start[u + 1]):
            g, x = self.clique[k], self.share[k]
            held = self.held[g]
            held[own] -= x
            if not held[own]:
                del held[own]
            held[to] = held.get(to, 0.0) + x
            self.changed.add(g)

    def stirred(self) -> list[int]:
        """Members of the cliques in which a node has moved since the last call."""
        parts = [self.members[self.members_start[g] : self.members_start[g + 1]] for g in sorted(self.changed)]
        self.changed.clear()
        return np.unique(np.concatenate(parts)).tolist() if parts else []


def _moved(net: Net, degree: np.ndarray, total: float, resolution: float, order: np.ndarray, label: list[int] | None = None) -> list[int]:
    """Local moving from labels (or from first ones): each node goes to the neighbouring community with the best gain in modularity until none moves."""
    label = net.first() if label is None else list(label)
    links_of = Links(net, label)
    volume = np.bincount(np.asarray(label, np.int64), degree, net.n).tolist()
    degree = memoryview(np.ascontiguousarray(degree))
    queue = order.tolist()
    waiting = set(queue)
    while queue:
        batch, queue = queue, []
        for u in batch:
            waiting.discard(u)
            own, d = label[u], degree[u]
            links = links_of.of(u)
            if len(links) == 1:
                continue
            volume[own] -= d
            # gains are as exact as their terms: what differs by less isn't better
            unit = max(d, 1.0)
            gain = lambda c: round((links[c] - resolution * d * volume[c] / total) / unit, 12)  # noqa: B023, E731
            best = max(sorted(links), key=lambda c: (gain(c), c == own))  # noqa: B023
            volume[best] += d
            if best != own:
                links_of.move(u, best)
                for v in links_of.near(u):
                    if label[v] != best and v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        for v in links_of.stirred():
            if v not in waiting:
                waiting.add(v)
                queue.append(v)
    return label


def louvain_labels(graph: Net, total: float, resolution: float = 1.0, seed: int = 0) -> list[int]:
    """Community of each node; total: twice the weight of the whole graph."""
    rng = np.random.default_rng(seed)
    net, label, start = graph, list(range(graph.n)), None
    while True:
        moved = _moved(net, net.degrees(), total, resolution, rng.permutation(net.n), start)
        upper, new = net.merged(moved)
        label = [new[c] for c in label]
        if upper.n == net.n:
            return label
        # cliques' members begin together, but not what was found to be better apart
        net, start = upper, list(range(upper.n))


def _smart(net: Net, label: list[int], total: float, resolution: float, rng: np.random.Generator, lowest: bool = True) -> list[int]:
    """One round of smart local moving from labels: nodes move; each community is split by moves within it; the parts become nodes, which move in turn."""
    degree = net.degrees()
    label = _moved(net, degree, total, resolution, rng.permutation(net.n), label)
    parts = _moved(net.inside(label), degree, total, resolution, rng.permutation(net.n), None if lowest else list(range(net.n)))
    if len(set(parts)) == net.n:
        return label
    of_part = dict(zip(parts, label, strict=True))
    upper, new = net.merged(parts)
    start = [0] * upper.n
    names: dict[int, int] = {}
    for part, k in dict(zip(parts, new, strict=True)).items():
        start[k] = names.setdefault(of_part[part], len(names))
    up = _smart(upper, start, total, resolution, rng, False)
    return [up[k] for k in new]


def smart_start(graph: Net, total: float, resolution: float, seed: int, start: int, rounds: int) -> tuple[float, list[int]]:
    """(modularity, communities) of one start."""
    rng = np.random.default_rng((seed, start))
    label = graph.first()
    for _ in range(rounds):
        new = _smart(graph, label, total, resolution, rng)
        names = {c: k for k, c in enumerate(dict.fromkeys(new))}
        new = [names[c] for c in new]
        if new == label:
            break
        label = new
    return modularity(graph, label, total, resolution), label


def smart_labels(graph: Net, total: float, resolution: float = 2.0, seed: int = 0, starts: int = 10, rounds: int = 10) -> list[int]:
    """Community of each node by smart local moving: the partition of most modularity among some starts of some rounds each."""
    found = (smart_start(graph, total, resolution, seed, start, rounds) for start in range(starts))
    return max(found, key=lambda x: round(x[0], 12))[1]


def modularity(graph: Net, label: list[int], total: float, resolution: float = 1.0) -> float:
    label = np.asarray(label, np.int64)
    volume = np.bincount(label, graph.degrees())
    inside = graph.within(label) + 2 * np.bincount(label, graph.loops)
    return float(np.sum(inside / total - resolution * (volume / total) ** 2))


def _h(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def code_length(graph: Net, label: list[int], total: float, outside: float = 0.0) -> float:
    """Two-level map equation of a component's modules, bits a step.  Flow is degree over total; outside: exit flow of other modules (none between components)."""
    label = np.asarray(label, np.int64)
    degree = graph.degrees() / total
    flow = np.bincount(label, degree)
    exits = np.maximum(np.bincount(label, graph.outward()) - graph.within(label), 0.0) / total
    bits = lambda x: sum(map(_h, x.tolist()))
    return _h(float(exits.sum()) + outside) - 2 * bits(exits) - bits(degree) + bits(exits + flow)


def map_equation_trial(graph: Net, total: float, seed: int = 0, trial: int = 0) -> tuple[float, list[int]]:
    """(code length, communities): nodes move while that shortens the code, then modules are merged into nodes."""
    rng = np.random.default_rng((seed, trial))
    net, label, module = graph, list(range(graph.n)), graph.first()
    while True:
        n = net.n
        out = net.outward() / total
        flow = out + 2 * net.loops / total
        now = np.asarray(module, np.int64)
        m_flow = np.bincount(now, flow, n).tolist()
        exits = np.bincount(now, out, n)
        inner = net.within(now) / total
        exits[: len(inner)] -= inner
        m_exit = np.maximum(exits, 0.0).tolist()
        out, flow = memoryview(out), memoryview(flow)
        q = sum(m_exit)
        links_of = Links(net, module)
        moving = True
        while moving:
            moving = False
            for u in rng.permutation(n).tolist():
                links = links_of.of(u)
                if len(links) == 1:
                    continue
                a, own_out, own_flow = module[u], out[u], flow[u]
                # module a without u
                a_exit, a_flow = max(m_exit[a] - own_out + 2 * links[a] / total, 0.0), m_flow[a] - own_flow
                fixed = _h(a_exit) * -2 + _h(a_exit + a_flow) + 2 * _h(m_exit[a]) - _h(m_exit[a] + m_flow[a]) - _h(q)

                def change(b: int) -> tuple[float, float, float]:
                    b_exit, b_flow = max(m_exit[b] + own_out - 2 * links[b] / total, 0.0), m_flow[b] + own_flow  # noqa: B023
                    q2 = q - m_exit[a] - m_exit[b] + a_exit + b_exit  # noqa: B023
                    return fixed + _h(q2) + 2 * _h(m_exit[b]) - _h(m_exit[b] + m_flow[b]) - 2 * _h(b_exit) + _h(b_exit + b_flow), b_exit, b_flow  # noqa: B023

                best = min((*change(b), b) for b in sorted(links) if b != a)
                if best[0] < -1e-12:
                    _, b_exit, b_flow, b = best
                    q += a_exit + b_exit - m_exit[a] - m_exit[b]
                    m_exit[a], m_flow[a], m_exit[b], m_flow[b] = a_exit, a_flow, b_exit, b_flow
                    links_of.move(u, b)
                    moving = True
        upper, new = net.merged(module)
        label = [new[c] for c in label]
        if upper.n == n:
            break
        net, module = upper, list(range(upper.n))
    return code_length(graph, label, total), label


def map_equation_labels(graph: Net, total: float, seed: int = 0, trials: int = 10) -> list[int]:
    """Greedy search for the shortest code: the best of some trials."""
    return min((map_equation_trial(graph, total, seed, trial) for trial in range(trials)), key=lambda x: round(x[0], 12))[1]


def _by_component(edges: DataFrame, cliques: DataFrame | None, search: Callable[[Graph, float, int], tuple[float, list[int]]], trials: int = 1) -> DataFrame:
    """(node, cl_id): search(graph, total, trial) gives (score, communities) of each component; those of the least score count. Clusters are numbered by their least node."""
    spark = ship(edges.sparkSession)
    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"), F.lit(False).alias("member"))
    if cliques is not None:
        rows = rows.unionByName(cliques.select(F.col("node").cast("long").alias("src"), F.col("clique").cast("long").alias("dst"), F.col("weight").cast("double"), F.lit(True).alias("member")))
    rows = written(rows)
    pairs, members = rows.where("not member").drop("member"), rows.where("member")
    total = pairs.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    if cliques is not None:
        size = members.groupBy("dst").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
        total += size.agg(F.coalesce(F.sum(F.col("weight") * F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
        pairs = pairs.unionByName(stars(members.select(F.col("dst").alias("clique"), F.col("src").alias("node"), "weight"), ["clique"]))
    total = 2 * float(total)

    def one(part: pa.Table) -> pa.Table:
        trial = part["trial"][0].as_py()
        src, dst, weight, member = (part[c].to_numpy() for c in ("src", "dst", "weight", "member"))
        graph = Graph(src[~member], dst[~member], weight[~member], (dst[member], src[member], weight[member]))
        score, label = search(graph, total, trial)
        label = np.asarray(label, np.int64)
        root = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(root, label, graph.nodes)
        n = graph.n
        return pa.table({"node": graph.nodes, "root": root[label], "least": np.full(n, graph.nodes[0]), "trial": np.full(n, trial, np.int32), "score": np.full(n, round(score, 12))})

    # a set number of partitions, which aren't joined for being small: a search is long beside its rows
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    rows = rows.join(connected(pairs).withColumnRenamed("node", "src"), "src").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    rows = rows.repartition(tasks, "component", "trial").groupBy("component", "trial")
    own = written(rows.applyInArrow(lambda part: one(part), "node long, root long, least long, trial int, score double"))
    if trials > 1:
        best = own.where("node = least").groupBy("least").agg(F.min(F.struct("score", "trial")).alias("_best")).select("least", F.col("_best.trial").alias("trial"))
        own = own.join(best, ["least", "trial"])
    return own.join(dense_ids(own.select("root").distinct(), "root", "cl_id"), "root").select("node", "cl_id")


def louvain(edges: DataFrame, resolution: float = 1.0, seed: int = 0, cliques: DataFrame | None = None) -> DataFrame:
    """(node, cl_id) by greedy modularity."""
    return _by_component(edges, cliques, lambda graph, total, _: (0.0, louvain_labels(graph, total, resolution, seed)))


def smart_moving(edges: DataFrame, resolution: float = 2.0, seed: int = 0, starts: int = 10, rounds: int = 10, cliques: DataFrame | None = None) -> DataFrame:
    """(node, cl_id) by smart local moving; each start is a task of its own."""

    def search(graph: Graph, total: float, start: int) -> tuple[float, list[int]]:
        value, label = smart_start(graph, total, resolution, seed, start, rounds)
        return -value, label

    return _by_component(edges, cliques, search, starts)


def map_equation(edges: DataFrame, seed: int = 0, trials: int = 10, cliques: DataFrame | None = None) -> DataFrame:
    """(node, cl_id) by the two-level map equation; each trial is a task of its own."""
    return _by_component(edges, cliques, lambda graph, total, trial: map_equation_trial(graph, total, seed, trial), trials)


def markov(edges: DataFrame, inflation: float = 1.2, rounds: int = 100, prune: float = 1e-4, tolerance: float = 1e-6) -> DataFrame:
    """(node, cl_id) by Markov clustering: M * M, powers, columns scaled to one, small entries out, until nothing changes; attractors' rows are clusters."""
    ends = both_ways(edges).groupBy("u", "v").agg(F.sum("weight").alias("m"))
    # a node without a self loop gets one of its heaviest weight
    loops = ends.groupBy("u").agg(F.max("m").alias("m"), F.max(F.when(F.col("u") == F.col("v"), F.col("m"))).alias("_own"))
    start = ends.where("u <> v").unionByName(loops.select("u", F.col("u").alias("v"), F.coalesce("_own", "m").alias("m")))

    def scaled(m: DataFrame) -> DataFrame:
        total = m.groupBy("v").agg(F.sum("m").alias("_t"))
        return m.join(total, "v").select("u", "v", (F.col("m") / F.col("_t")).alias("m"))

    now = written(scaled(start))
    for _ in range(rounds):
        left, right = now.select("u", F.col("v").alias("_k"), F.col("m").alias("_a")), now.select(F.col("u").alias("_k"), "v", F.col("m").alias("_b"))
        squared = left.join(right, "_k").groupBy("u", "v").agg(F.sum(F.col("_a") * F.col("_b")).alias("m"))
        inflated = scaled(squared.withColumn("m", F.pow("m", F.lit(inflation))))
        new = written(scaled(inflated.where(F.col("m") >= prune)))
        change = new.join(now.withColumnRenamed("m", "_old"), ["u", "v"], "full").agg(F.max(F.abs(F.coalesce("m", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))))).first()[0]
        now = new
        if change is None or change < tolerance:
            break
    # a node belongs to the attractors of its column; attractors that share a node are one cluster
    strong = now.where(F.col("m") > prune).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("weight"))
    parts = connected(strong)
    roots = dense_ids(parts.select("component").distinct(), "component", "cl_id")
    return parts.join(roots, "component").select("node", "cl_id")


def clustered(edges: DataFrame, method: str = "infomap", seed: int = 0, **more) -> DataFrame:
    """Communities by name: infomap (map equation), louvain, mcl (inflation 1.2), slm (smart local moving, resolution 2)."""
    if method == "infomap":
        return map_equation(edges, seed, **more)
    if method == "louvain":
        return louvain(edges, seed=seed, **more)
    if method == "mcl":
        if more.pop("cliques", None) is not None:
            raise UnsupportedError("mcl takes edges, not cliques")
        return markov(edges, **more)
    if method == "slm":
        return smart_moving(edges, seed=seed, **more)
    if method == "simap":
        raise UnsupportedError("simap isn't offered: its method isn't public")
    raise ValueError(f"{method}: the methods are infomap, louvain, mcl and slm")
