"""Centrality: degree, betweenness of nodes and edges, closeness.

Degree is a plain aggregation. The others run one single-source search per source: the graph, if its size
checks out, is broadcast as arrays, sources are spread over tasks, and partial sums meet in one aggregation.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import ship, shuffle_partitions
from loomkg.operators.edges import LOCAL_ARCS, Graph, check_direction, collected, held, is_small

EPS = 1e-10


def degree(edges: DataFrame, direction: str = "both", normalized: bool = False) -> DataFrame:
    """(node, in_degree, out_degree, degree, centrality): weighted; centrality is degree, over N - 1 if normalized."""
    check_direction(direction)
    zero = F.lit(0.0)
    outs = edges.select(F.col("src").alias("node"), (F.col("weight") if direction != "reverse" else zero).alias("o"), zero.alias("i"))
    ins = edges.select(F.col("dst").alias("node"), zero.alias("o"), (F.col("weight") if direction != "forward" else zero).alias("i"))
    sums = outs.unionAll(ins).groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    if not normalized:
        return sums.withColumn("centrality", F.col("degree"))
    n = sums.agg(F.count("*").alias("n"))
    return sums.crossJoin(F.broadcast(n)).withColumn("centrality", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.col("degree"))).drop("n")


def _small(edges: DataFrame, limit: int) -> Graph:
    if not is_small(edges, limit):
        raise ValueError(f"more than {limit} arcs: raise local_arcs if the graph fits in memory, or sample or split it")
    return collected(edges)


def search(offs: np.ndarray, to: np.ndarray, w: np.ndarray, s: int, n: int) -> tuple[np.ndarray, np.ndarray, list[int], list[list[int]]]:
    """(distance, number of shortest paths, nodes by distance, predecessors) over distinct arcs."""
    dist, sigma = np.full(n, np.inf), np.zeros(n)
    pred: list[list[int]] = [[] for _ in range(n)]
    dist[s], sigma[s] = 0.0, 1.0
    order: list[int] = []
    heap, done = [(0.0, s)], np.zeros(n, bool)
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for i in range(offs[v], offs[v + 1]):
            t, x = int(to[i]), d + w[i]
            if x < dist[t] - EPS:
                dist[t], sigma[t], pred[t] = x, sigma[v], [v]
                heapq.heappush(heap, (x, t))
            elif abs(x - dist[t]) <= EPS and not done[t]:
                sigma[t] += sigma[v]
                pred[t].append(v)
    return dist, sigma, order, pred


def _sources(n: int, threshold: int) -> np.ndarray:
    """All nodes, or about sqrt(n) at equal steps where the graph is larger than the threshold."""
    if threshold and n > threshold:
        return np.arange(0, n, max(1, n // math.ceil(math.sqrt(n))))
    return np.arange(n)


def _spread(edges: DataFrame, graph: Graph, sources: np.ndarray, f, schema: str) -> DataFrame:  # noqa: ANN001
    spark = edges.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((graph, sources))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, src = sent.value
        for frame in frames:
            out = f(g, src[frame["id"].to_numpy()])
            if len(out):
                yield out

    tasks = max(1, min(len(sources), 4 * max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)))
    return spark.range(0, len(sources), 1, tasks).mapInPandas(run, schema)


def hops(offs: np.ndarray, to: np.ndarray, s: int, n: int) -> np.ndarray:
    """Hops from s, -1 where there is no way."""
    dist = np.full(n, -1, np.int64)
    dist[s] = 0
    front, level = np.array([s]), 0
    while len(front):
        size = offs[front + 1] - offs[front]
        t = to[np.repeat(offs[front] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        new = np.zeros(n, bool)
        new[t[dist[t] < 0]] = True
        front = np.flatnonzero(new)
        level += 1
        dist[front] = level
    return dist


def levels(offs: np.ndarray, to: np.ndarray, s: int, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hops or -1, number of shortest paths, arcs on shortest paths by level), whole levels at a time."""
    dist, sigma = np.full(n, -1, np.int64), np.zeros(n)
    dist[s], sigma[s] = 0, 1.0
    front, level, used = np.array([s]), 0, []
    while len(front):
        size = offs[front + 1] - offs[front]
        at = np.repeat(offs[front] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        t = to[at]
        new = np.zeros(n, bool)
        new[t[dist[t] < 0]] = True
        on = new[t]
        at, t, by = at[on], t[on], np.repeat(front, size)[on]
        front = np.flatnonzero(new)
        level += 1
        dist[front] = level
        if len(at):
            sigma += np.bincount(t, sigma[by], n)
            used.append(at)
    return dist, sigma, used


def _flow(g: Graph, sources: np.ndarray, direction: str, weighted: bool, by_edge: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sum of dependencies of each node, (from, to, flow) of each distinct arc) over the sources."""
    offs, to, w = g.csr(direction, "min")
    owner = np.repeat(np.arange(g.n), np.diff(offs))
    node, flow = np.zeros(g.n), np.zeros(len(to))
    for s in sources.tolist():
        delta = np.zeros(g.n)
        if weighted:
            _, sigma, order, pred = search(offs, to, w, s, g.n)
            for t in reversed(order):
                for v in pred[t]:
                    c = sigma[v] / sigma[t] * (1 + delta[t])
                    delta[v] += c
                    if by_edge:
                        flow[offs[v] + np.searchsorted(to[offs[v] : offs[v + 1]], t)] += c
        else:
            _, sigma, used = levels(offs, to, s, g.n)
            for at in reversed(used):
                v, t = owner[at], to[at]
                c = sigma[v] / sigma[t] * (1 + delta[t])
                delta += np.bincount(v, c, g.n)
                if by_edge:
                    flow[at] += c
        delta[s] = 0
        node += delta
    some = np.flatnonzero(flow)
    return node, (owner[some], to[some], flow[some])


def _scale(n: int, used: int, direction: str, normalized: bool) -> float:
    x = n / max(used, 1)
    if direction == "both":
        x /= 2
    if normalized and n > 2:
        x /= (n - 1) * (n - 2) / (2 if direction == "both" else 1)
    return x


def node_betweenness(edges: DataFrame, direction: str = "forward", normalized: bool = False, weighted: bool = False, auto_approx_threshold: int = 50_000, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, centrality) of every node, zeros included; above the threshold about sqrt(N) sources are extrapolated."""
    check_direction(direction)
    edges = held(edges)
    g = _small(edges, local_arcs)
    src = _sources(g.n, auto_approx_threshold)
    k = _scale(g.n, len(src), direction, normalized)

    def part(g: Graph, sources: np.ndarray) -> pd.DataFrame:
        node, _ = _flow(g, sources, direction, weighted, False)
        at = np.arange(g.n) if 0 in sources else np.flatnonzero(node)
        return pd.DataFrame({"node": g.names[at], "c": node[at]})

    return _spread(edges, g, src, part, "node string, c double").groupBy("node").agg((F.sum("c") * k).alias("centrality"))


def edge_betweenness(edges: DataFrame, direction: str = "forward", normalized: bool = False, weighted: bool = False, auto_approx_threshold: int = 0, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(src, dst, centrality): one row for each stored edge with a flow in its own direction; 'reverse' stores none."""
    check_direction(direction)
    edges = held(edges)
    g = _small(edges, local_arcs)
    src = _sources(g.n, auto_approx_threshold)
    k = _scale(g.n, len(src), direction, normalized)

    def part(g: Graph, sources: np.ndarray) -> pd.DataFrame:
        _, (a, b, c) = _flow(g, sources, direction, weighted, True)
        return pd.DataFrame({"src": g.names[a], "dst": g.names[b], "c": c})

    flow = _spread(edges, g, src, part, "src string, dst string, c double").groupBy("src", "dst").agg((F.sum("c") * k).alias("centrality"))
    stored = edges.select("src", "dst")
    if direction == "reverse":
        stored = stored.limit(0)
    return stored.join(flow.where("centrality > 0"), ["src", "dst"]).select("src", "dst", "centrality")


def closeness(edges: DataFrame, direction: str = "forward", normalized: bool = True, weighted: bool = False, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, centrality): reached nodes over the sum of distances, times reached / (N - 1) if normalized."""
    check_direction(direction)
    edges = held(edges)
    g = _small(edges, local_arcs)

    def part(g: Graph, sources: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"node": g.names[sources], "centrality": close(g, sources, direction, normalized, weighted)})

    return _spread(edges, g, np.arange(g.n), part, "node string, centrality double")


def close(g: Graph, sources: np.ndarray, direction: str, normalized: bool, weighted: bool) -> list[float]:
    offs, to, w = g.csr(direction, "min")
    out = []
    for s in sources.tolist():
        if weighted:
            dist = search(offs, to, w, s, g.n)[0]
        else:
            depth = hops(offs, to, s, g.n)
            dist = np.where(depth < 0, np.inf, depth)
        far = dist[np.isfinite(dist)]
        r, total = len(far) - 1, float(far.sum())
        c = r / total if total > 0 else 0.0
        out.append(c * r / (g.n - 1) if normalized and g.n > 1 else c)
    return out
