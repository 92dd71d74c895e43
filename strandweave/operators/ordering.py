"""Orders of cluster members: distances from similarities, tours, hierarchical clustering, and a graphical heuristic.

One grouped task for each cluster: a cluster's cells make a dense matrix there, nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..errors import TooFewError, UnsupportedError
from ..tables import written
from .community import Graph, louvain, louvain_labels
from .graph import stars
from .reports import eligible

#: The largest distance that a 32-bit tour solver takes, before it is shared out.
LARGEST = 2**31 - 1
#: Links up to which a tour is the shortest there is, by dynamic programming over subsets.
EXACT = 8


def reciprocal_distance(similarity: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """Shares of the largest smoothed similarity, inverted, so that the least distance is 1.01; diagonal 0."""
    if (similarity < 0).any():
        raise ValueError("similarities can't be negative")
    smooth = similarity.astype(float)
    np.fill_diagonal(smooth, 0)
    smooth += alpha
    out = smooth.max() / smooth
    out *= 1.01 / out.min()
    np.fill_diagonal(out, 0)
    return out


def scaled_range(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """x put linearly on [low, high]; a constant matrix is low everywhere."""
    span = x.max() - x.min()
    return np.full(x.shape, float(low)) if span == 0 else low + (x - x.min()) / span * (high - low)


def similarity_distance(similarity: np.ndarray, method: str, alpha: float = 2, beta: float = 1, headroom: float = 1) -> np.ndarray:
    """Distances on [1, LARGEST / 2 / n / headroom] from similarities: inverse 1/x, linear 1 - x/max, neglog -ln(x/max), to the power beta.

    What was never seen together (and the diagonal) is alpha times as far as the farthest.
    """
    if alpha < 1:
        raise ValueError("alpha is 1 at least")
    s = similarity.astype(float)
    np.fill_diagonal(s, 0)
    seen = s != 0
    if not seen.any():
        raise ValueError("there is no similarity above zero")
    share = s / s.max()
    far = np.zeros_like(s)
    if method == "inverse":
        far[seen] = 1 / s[seen]
    elif method == "linear":
        far = 1 - share
    elif method == "neglog":
        far[seen] = -np.log(share[seen])
    else:
        raise ValueError(f"{method}: the methods are inverse, linear and neglog")
    far = far**beta
    far[~seen] = alpha * far.max()
    return scaled_range(far, 1, LARGEST / 2 / len(s) / headroom)


def similarity_grid(cells: DataFrame) -> DataFrame:
    """(i, j, s): every ordered pair of the ids of an upper-triangle table (i, j, value) with its similarity, zero where there is none and on the diagonal.

    One cluster's grid: it has as many rows as its distance matrix has cells, by definition.
    """
    ids = written(cells.select(F.explode(F.array("i", "j")).alias("id")).distinct())
    seen = cells.where("i <> j").select("i", "j", "value").union(cells.where("i <> j").select("j", "i", "value"))
    grid = ids.select(F.col("id").alias("i")).join(ids.select(F.col("id").alias("j")))
    return grid.join(seen, ["i", "j"], "left").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("s"))


def distance_cells(grid: DataFrame, method: str, alpha: float = 2, beta: float = 1, headroom: float = 1) -> DataFrame:
    """similarity_distance() over a grid (i, j, s), in DataFrame operations: (i, j, distance)."""
    if alpha < 1:
        raise ValueError("alpha is 1 at least")
    top = grid.agg(F.max("s").alias("_top"), F.sqrt(F.count("*")).alias("_n"))  # one row
    share = F.col("s") / F.col("_top")
    ways = {"inverse": 1 / F.col("s"), "linear": 1 - share, "neglog": -F.log(share)}
    if method not in ways:
        raise ValueError(f"{method}: the methods are inverse, linear and neglog")
    checked = F.when(F.col("_top") > 0, F.col("s")).otherwise(F.raise_error(F.lit("there is no similarity above zero")).cast("double"))
    seen = F.when(checked != 0, F.pow(ways[method], F.lit(float(beta))))
    rows = grid.crossJoin(F.broadcast(top)).select("i", "j", "_n", seen.alias("_f"))
    # linear distances of what is unseen are 1 before they are stretched
    least = 1.0 if method == "linear" else 0.0
    far = rows.agg((alpha * F.greatest(F.max("_f"), F.max(F.when(F.col("_f").isNull(), F.lit(least))))).alias("_far"))
    rows = rows.crossJoin(F.broadcast(far)).select("i", "j", "_n", F.coalesce("_f", "_far").alias("_f"))
    ends = rows.agg(F.min("_f").alias("_low"), F.max("_f").alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span == 0, F.lit(1.0)).otherwise(1 + (F.col("_f") - F.col("_low")) / span * (LARGEST / 2 / F.col("_n") / headroom - 1))
    return rows.crossJoin(F.broadcast(ends)).select("i", "j", scaled.alias("distance"))


def reciprocal_cells(grid: DataFrame, alpha: float = 0.1) -> DataFrame:
    """reciprocal_distance() over a grid (i, j, s), in DataFrame operations: (i, j, distance)."""
    top = grid.agg(F.max("s").alias("_top"), F.min("s").alias("_low"))  # one row
    checked = F.when(F.col("_low") >= 0, F.col("s")).otherwise(F.raise_error(F.lit("similarities can't be negative")).cast("double"))
    # the least distance is that of the largest similarity
    far = 1.01 * (F.col("_top") + alpha) / (checked + alpha)
    return grid.crossJoin(F.broadcast(top)).select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(far).alias("distance"))


def tour(distance: np.ndarray, seed: int = 0, fixed: list[tuple[int, int]] | None = None, runs: int = 5) -> list[int]:
    """A short closed tour that holds the fixed edges (each node in one at most): nearest neighbours, then 2-opt and moved segments;
    the shortest of all for up to EXACT links.

    Fixed pairs travel as one: a tour is a sequence of links (node in, node out), which are turned and moved whole.
    """
    n = len(distance)
    d = distance.astype(float)
    mates = {a: b for a, b in fixed or []} | {b: a for a, b in fixed or []}
    links = [(a, mates.get(a, a)) for a in range(n) if a <= mates.get(a, a)]
    m = len(links)
    if m <= EXACT:
        return [x for a, b in _shortest(d, links) for x in ((a, b) if a != b else (a,))]
    rng = np.random.default_rng(seed)
    best: tuple[float, list[tuple[int, int]]] | None = None

    def length(seq: list[tuple[int, int]]) -> float:
        return sum(d[seq[i - 1][1], seq[i][0]] for i in range(len(seq)))

    for _ in range(max(1, runs)):
        start = int(rng.integers(m))
        left = set(range(m)) - {start}
        seq = [links[start]]
        while left:
            at = seq[-1][1]
            # the nearer end of the nearest link
            _, k, turn = min((d[at, links[k][t]], k, t) for k in left for t in (0, 1))
            left.discard(k)
            seq.append(links[k] if turn == 0 else links[k][::-1])
        improved = True
        while improved and m > 2:
            improved = False
            for i in range(m - 1):
                for j in range(i + 1, m):
                    if i == 0 and j == m - 1:
                        continue
                    a, b = seq[i - 1][1], seq[i][0]
                    c, e = seq[j][1], seq[(j + 1) % m][0]
                    if d[a, c] + d[b, e] < d[a, b] + d[c, e] - 1e-9:
                        seq[i : j + 1] = [x[::-1] for x in reversed(seq[i : j + 1])]
                        improved = True
            for size in (1, 2, 3):
                if m < size + 3:
                    break
                for i in range(m):
                    ring = seq[i:] + seq[:i]
                    part, rest = ring[:size], ring[size:]
                    gain = d[rest[-1][1], part[0][0]] + d[part[-1][1], rest[0][0]] - d[rest[-1][1], rest[0][0]]
                    back = [x[::-1] for x in reversed(part)]
                    options = []
                    for k in range(1, len(rest)):
                        a, b = rest[k - 1][1], rest[k][0]
                        options += [(d[a, p[0][0]] + d[p[-1][1], b] - d[a, b], k, t) for t, p in enumerate((part, back))]
                    cost, k, t = min(options)
                    if cost < gain - 1e-9:
                        seq = rest[:k] + (back if t else part) + rest[k:]
                        improved = True
        now = length(seq)
        if best is None or now < best[0] - 1e-9:
            best = (now, list(seq))
    return [x for a, b in best[1] for x in ((a, b) if a != b else (a,))]


def _shortest(d: np.ndarray, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The shortest closed tour over all links, from the first of them: least ways by the set of links passed and the last one and its direction."""
    m = len(links)
    ways = {(1, 0, 0): (0.0, None)}  # links passed, the last, whether it is turned: length and the state before
    layer = list(ways)
    for _ in range(m - 1):
        reached: dict[tuple[int, int, int], None] = {}
        for state in layer:
            passed, last, turned = state
            at = links[last][1 - turned]
            for k in range(1, m):
                if not passed >> k & 1:
                    for t in (0, 1) if links[k][0] != links[k][1] else (0,):
                        length = ways[state][0] + d[at, links[k][t]]
                        new = (passed | 1 << k, k, t)
                        if new not in ways or length < ways[new][0]:
                            ways[new] = (length, state)
                        reached[new] = None
        layer = list(reached)
    state = min(layer, key=lambda s: (ways[s][0] + d[links[s[1]][1 - s[2]], links[0][0]], s))
    out = []
    while state is not None:
        out.append(links[state[1]][::-1] if state[2] else links[state[1]])
        state = ways[state][1]
    return out[::-1]


def closed_length(distance: np.ndarray, path: list[int]) -> float:
    """Of a closed tour."""
    return float(sum(distance[a, b] for a, b in zip(path, path[1:] + path[:1], strict=True)))


def find_order(similarity: np.ndarray, seed: int = 0, method: str = "inverse", runs: int = 5, tips: bool = False, alpha: float = 1.2, beta: float = 1) -> list[tuple[int, int]]:
    """(index, orientation) along a tour of a symmetric similarity matrix; with tips, rows 2i and 2i + 1 are the ends of i and stay together.

    A tour starts at a link's first end, so ends are decoded in pairs: 2i before 2i + 1 is forward.
    """
    if len(similarity) < 3:
        raise TooFewError(f"{len(similarity)} rows are too few to order")
    distance = similarity_distance(similarity, method, alpha, beta)
    if not tips:
        return [(x, 1) for x in tour(distance, seed, runs=runs)]
    path = tour(distance, seed, [(i, i + 1) for i in range(0, len(distance), 2)], runs)
    return [(a // 2, b - a) for a, b in zip(path[::2], path[1::2], strict=True)]


def ordered_clusters(cells: DataFrame, members: DataFrame, clusters: DataFrame | None = None, seed: int = 0, dist_method: str = "neglog", min_extent: int = 0, min_size: int = 3, runs: int = 5, tips: bool = False) -> DataFrame:
    """(cl_id, rank, seq_id, ori, tour_length): each eligible cluster's order, all clusters at a time; the tour's length repeats on its rows.

    cells: upper triangle (i, j, value), with k and l for tips.  Clusters of fewer than three rows, and those without a contact, have no order.
    """
    ship(cells.sparkSession)
    if clusters is not None:
        kept = eligible(clusters, min_extent, min_size).select("cl_id")
        members = members.join(kept, "cl_id", "left_semi")
    rows = cells
    for x in ("i", "j"):
        rows = rows.join(members.select(F.col("seq_id").alias(x), F.col("cl_id").alias(f"_{x}")), x)
    ends = ["k", "l"] if tips else []
    rows = rows.where("_i = _j").select(F.col("_i").alias("cl_id"), "i", "j", *ends, "value")
    own = members.select("cl_id", F.col("seq_id").alias("i"), F.col("seq_id").alias("j"), *[F.lit(0).cast("byte").alias(x) for x in ends], F.lit(0.0).alias("value"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((part["i"], part["j"])))
        a, b = np.searchsorted(ids, part["i"]), np.searchsorted(ids, part["j"])
        step = 1
        if tips:
            step, a, b = 2, 2 * a + part["k"].to_numpy(), 2 * b + part["l"].to_numpy()
        s = np.zeros((step * len(ids), step * len(ids)))
        v = part["value"].to_numpy()
        np.add.at(s, (a, b), v)
        off = a != b
        np.add.at(s, (b[off], a[off]), v[off])
        try:
            found = find_order(s, seed, dist_method, runs, tips)
        except (TooFewError, ValueError):
            found = []
        out = pd.DataFrame(found, columns=["at", "ori"]).astype({"at": int, "ori": np.int8})
        path = [x for a, o in found for x in ((2 * a, 2 * a + 1)[::o] if tips else (a,))]
        length = closed_length(similarity_distance(s, dist_method, 1.2, 1), path) if found else 0.0
        return pd.DataFrame({"cl_id": part["cl_id"].iloc[0], "rank": np.arange(len(out), dtype=np.int32), "seq_id": ids[out["at"].to_numpy(int)] if len(out) else np.zeros(0, np.int32), "ori": out["ori"], "tour_length": length})

    every = rows.withColumn("value", F.col("value").cast("double")).unionByName(own)
    return every.groupBy("cl_id").applyInPandas(lambda part: one(part), "cl_id int, rank int, seq_id int, ori byte, tour_length double")


def linkage(rows: np.ndarray, method: str = "ward") -> list[tuple[int, int, float]]:
    """Agglomerative merges (a, b, height) over city-block distances of rows, by nearest pairs; merge k makes node n + k."""
    n = len(rows)
    d = np.abs(rows[:, None, :] - rows[None, :, :]).sum(2).astype(float)
    np.fill_diagonal(d, np.inf)
    size, name, alive = [1.0] * n, list(range(n)), list(range(n))
    out = []
    for k in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        x, y = np.unravel_index(int(np.argmin(sub)), sub.shape)
        a, b = alive[min(x, y)], alive[max(x, y)]
        height = d[a, b]
        out.append((min(name[a], name[b]), max(name[a], name[b]), float(height)))
        for c in alive:
            if c in (a, b):
                continue
            if method == "complete":
                new = max(d[a, c], d[b, c])
            elif method == "ward":
                total = size[a] + size[b] + size[c]
                new = np.sqrt(max(0.0, ((size[a] + size[c]) * d[a, c] ** 2 + (size[b] + size[c]) * d[b, c] ** 2 - size[c] * height**2) / total))
            else:
                raise ValueError(f"{method}: the methods are ward and complete")
            d[a, c] = d[c, a] = new
        size[a] += size[b]
        name[a] = n + k
        alive.remove(b)
    return out


def leaf_order(rows: np.ndarray, merges: list[tuple[int, int, float]], optimal: bool = True) -> list[int]:
    """Leaves of a merge tree; optimal: subtrees are turned so that neighbours' distances add up to the least (dynamic programming over end leaves)."""
    n = len(rows)
    if n == 1:
        return [0]
    d = np.abs(rows[:, None, :] - rows[None, :, :]).sum(2)
    leaves = {i: [i] for i in range(n)}
    # best[node][first, last] = (cost, how): the cheapest order of a node's leaves between two ends
    best: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {i: {(i, i): (0.0, None)} for i in range(n)}
    for k, (a, b, _) in enumerate(merges):
        node = n + k
        leaves[node] = leaves[a] + leaves[b]
        if not optimal:
            continue
        table: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (u, m), (left, _) in best[a].items():
            for (w, v), (right, _) in best[b].items():
                cost = left + d[m, w] + right
                if (u, v) not in table or cost < table[u, v][0]:
                    table[u, v] = (cost, (a, u, m, b, w, v))
                    table[v, u] = (cost, (b, v, w, a, m, u))
        best[node] = table
    root = n + len(merges) - 1
    if not optimal:
        return leaves[root]
    out: list[int] = []
    ends = min(best[root], key=lambda e: (best[root][e][0], e))
    stack = [(root, *ends)]
    while stack:
        node, u, v = stack.pop()
        how = best[node][u, v][1]
        if how is None:
            out.append(node)
        else:
            a, u1, m, b, w, v1 = how
            stack += [(b, w, v1), (a, u1, m)]
    return out


#: Nodes of a graph that is ordered as a whole, in one task's memory, at most: its matrix has their square.
WHOLE_NODES = 20_000


def _whole(edges: DataFrame, order: Callable[[pd.DataFrame], list[int]], by: str | None) -> DataFrame:
    ship(edges.sparkSession)
    if by is None:
        n = edges.select(F.explode(F.array("src", "dst")).alias("u")).distinct().count()
        if n > WHOLE_NODES:
            raise UnsupportedError(f"{n} nodes are ordered by their clusters, not as a whole (by=)")
    rows = edges if by else edges.withColumn("cl_id", F.lit(0))
    key = by or "cl_id"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        found = order(part.sort_values(["src", "dst"]))
        return pd.DataFrame({"cl_id": int(part[key].iloc[0]), "rank": np.arange(len(found), dtype=np.int32), "node": np.array(found, np.int64)})

    return rows.groupBy(key).applyInPandas(lambda part: one(part), "cl_id int, rank int, node long")


def hierarchical_order(edges: DataFrame, method: str = "ward", optimal: bool = True, by: str | None = None) -> DataFrame:
    """(cl_id, rank, node) by hierarchical clustering of adjacency rows; by: a column of edges whose groups are ordered apart."""

    def order(part: pd.DataFrame) -> list[int]:
        ids = np.unique(np.concatenate((part["src"], part["dst"])))
        m = np.zeros((len(ids), len(ids)))
        a, b = np.searchsorted(ids, part["src"]), np.searchsorted(ids, part["dst"])
        m[a, b] = m[b, a] = part["weight"]
        return ids[leaf_order(m, linkage(m, method), optimal)].tolist()

    return _whole(edges, order, by)


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest one-to-one assignment, by shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)
    for i in range(n):
        reach, came, done = np.full(n + 1, np.inf), np.full(n + 1, n), np.zeros(n + 1, bool)
        row_of[n] = i
        j = n
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            free = np.flatnonzero(~done[:n])
            reduced = cost[r, free] - u[r] - v[free]
            closer = reduced < reach[free]
            reach[free[closer]], came[free[closer]] = reduced[closer], j
            k = int(free[np.argmin(reach[free])])
            step = reach[k]
            for c in np.flatnonzero(done):
                u[row_of[c]] += step
                v[c] -= step
            reach[free] -= step
            j = k
        while j != n:
            row_of[j] = row_of[came[j]]
            j = int(came[j])
    out = [0] * n
    for j in range(n):
        out[row_of[j]] = j
    return out


def spanning_tree(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Edges of a least spanning forest; ties by nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges if a != b):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            out.append((a, b, w))
    return out


def heavy_first(edges: list[tuple[int, int, float]], source: int | None = None) -> list[tuple[int, int]]:
    """Depth-first edges, the heaviest first, ties by node; from the source, or over all components by node."""
    ends = pd.DataFrame([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges], columns=["node", "other", "weight"])
    # what is pushed last is popped first, so the heaviest edge to the least node comes last
    ends = ends.sort_values(["node", "weight", "other"], ascending=[True, True, False])
    onward = {node: part["other"].tolist() for node, part in ends.groupby("node")}
    pending = [(None, node) for node in (sorted(onward, reverse=True) if source is None else [source])]
    visited: set[int] = set()
    walk = []
    while pending:
        origin, node = pending.pop()
        if node in visited:
            continue
        visited.add(node)
        if origin is not None:
            walk.append((origin, node))
        pending.extend((node, other) for other in onward.get(node, ()))
    return walk


def _walk(inner: list[tuple[int, int, float]]) -> list[int]:
    """Nodes of a depth-first walk of the least spanning tree, the heaviest of its edges first."""
    return list(dict.fromkeys(x for edge in heavy_first(spanning_tree(inner)) for x in edge))


def _by_communities(edges: DataFrame, cliques: DataFrame | None, alpha: float, seed: int, weight: str) -> DataFrame:
    """graphical_order of a whole graph: a task for each component's communities, one for their order, and one for the walk of each."""
    label = written(louvain(edges, seed=seed, cliques=cliques))
    sizes = written(label.groupBy("cl_id").agg(F.count("*").alias("n")))
    n = sizes.count()
    if n > WHOLE_NODES:
        raise UnsupportedError(f"{n} communities, more than {WHOLE_NODES} of a matrix, aren't put in order")
    ends = edges.select("src", "dst", F.col("weight").alias("w"), F.col(weight).alias("x"))
    for x in ("src", "dst"):
        ends = ends.join(label.select(F.col("node").alias(x), F.col("cl_id").alias(f"c_{x}")), x)
    between = ends.where("c_src <> c_dst").select(F.least("c_src", "c_dst").alias("p"), F.greatest("c_src", "c_dst").alias("q"), "x", F.lit(1).cast("long").alias("k"))
    inner = ends.where("c_src = c_dst").select(F.col("c_src").alias("cl_id"), "src", "dst", "w")
    # a node's own row keeps it in its community's part
    inner = inner.unionByName(label.select("cl_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w")))
    if cliques is not None:
        held = cliques.join(label, "node").select("clique", "node", "weight", "cl_id")
        shares = held.groupBy("clique", "cl_id").agg(F.count("*").alias("k"), F.max("weight").alias("weight"))
        split = shares.alias("a").join(shares.alias("b"), "clique").where("a.cl_id < b.cl_id").select(F.col("a.cl_id").alias("p"), F.col("b.cl_id").alias("q"), (F.col("a.weight") * F.col("a.k") * F.col("b.k")).alias("x"), (F.col("a.k") * F.col("b.k")).alias("k"))
        between = between.unionByName(split)
        # of a clique's equal edges, ties by nodes, a least spanning tree takes those of the least node
        star = stars(held, ["clique", "cl_id"]).join(label.withColumnRenamed("node", "src"), "src")
        inner = inner.unionByName(star.select("cl_id", "src", "dst", F.col("weight").alias("w")))
    cells = between.groupBy("p", "q").agg((F.sum("x") / F.sum("k")).alias("mean"))
    cells = cells.unionByName(sizes.select(F.col("cl_id").alias("p"), F.col("cl_id").alias("q"), F.lit(0.0).alias("mean")))

    def places(part: pd.DataFrame) -> pd.DataFrame:
        mean = np.zeros((n, n))
        mean[part["p"], part["q"]] = part["mean"]
        return pd.DataFrame({"cl_id": np.array(assignment(1 / (mean + alpha)), np.int32), "place": np.arange(n, dtype=np.int32)})

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        inner = zip(part["src"].tolist(), part["dst"].tolist(), (1 / (part["w"] + alpha)).tolist(), strict=True)
        found = list(dict.fromkeys(_walk(list(inner)) + sorted(set(part["src"]))))
        return pd.DataFrame({"cl_id": part["cl_id"].iloc[0], "at": np.arange(len(found), dtype=np.int32), "node": np.array(found, np.int64)})

    place = cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda part: places(part), "cl_id int, place int")
    row = Window.orderBy(F.col("n") == 1, "place").rowsBetween(Window.unboundedPreceding, -1)  # a row for each community
    base = place.join(sizes, "cl_id").withColumn("base", F.coalesce(F.sum("n").over(row), F.lit(0))).select("cl_id", "base")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * edges.sparkSession.sparkContext.defaultParallelism)
    walks = inner.repartition(tasks, "cl_id").groupBy("cl_id").applyInPandas(lambda part: walked(part), "cl_id int, at int, node long")
    return walks.join(base, "cl_id").select(F.lit(0).alias("cl_id"), (F.col("base") + F.col("at")).cast("int").alias("rank"), "node")


def graphical_order(edges: DataFrame, alpha: float = 1.0, seed: int = 0, weight: str = "weight", by: str | None = None, cliques: DataFrame | None = None) -> DataFrame:
    """(cl_id, rank, node): communities in the order of a linear assignment on their inverted mean weights; within each, a
    depth-first walk of the least spanning tree over inverted weights, the heaviest of those (the weakest contact) first; single nodes last.

    cliques (clique, node, weight): more edges, between each two nodes of a clique; of a whole graph only.
    """
    if by is None:
        return _by_communities(edges, cliques, alpha, seed, weight)
    if cliques is not None:
        raise UnsupportedError("cliques are of a whole graph, not of one that is ordered by=")

    def order(part: pd.DataFrame) -> list[int]:
        graph = Graph(part["src"].to_numpy(), part["dst"].to_numpy(), part["weight"].to_numpy())
        label = louvain_labels(graph, 2 * float(part["weight"].sum()), seed=seed)
        of = dict(zip(graph.nodes.tolist(), label, strict=True))
        m = max(label) + 1
        total, count = np.zeros((m, m)), np.zeros((m, m))
        inner: list[list[tuple[int, int, float]]] = [[] for _ in range(m)]
        for a, b, w, x in zip(part["src"].tolist(), part["dst"].tolist(), part["weight"].tolist(), part[weight].tolist(), strict=True):
            p, q = sorted((of[a], of[b]))
            if p == q:
                inner[p].append((a, b, 1 / (w + alpha)))
            else:
                total[p, q] += x
                count[p, q] += 1
        mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
        out, alone = [], []
        for c in assignment(1 / (mean + alpha)):
            members = [u for u in sorted(of) if of[u] == c]
            if len(members) == 1:
                alone += members
                continue
            out += _walk(inner[c])
        return out + alone

    return _whole(edges, order, by)
