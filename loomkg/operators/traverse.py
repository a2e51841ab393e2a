"""Traversal: breadth first, depth first, shortest paths, components and PageRank.

A graph of checked size is walked by one task on arrays; larger ones by loops of DataFrame joins whose
lineage is cut with reliable checkpoints. Both give the same rows.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import checkpointed, drop_path, new_path, shuffle_partitions
from loomkg.operators.edges import LOCAL_ARCS, Graph, arcs, check_direction, held, in_one_task, is_small, nodes

_REACH = "node string, depth int, parent string"
#: Nodes of a level that are sent to all tasks at once.
_FRONT = 100_000
#: Arcs of a bucket.
_BUCKET = 4_000_000
_PATH = "node string, distance double, path_order int"


def reach(offs: np.ndarray, targets: np.ndarray, seeds: list[int], n: int, max_depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(depth or -1, least parent of the level before or -1) by whole levels."""
    depth, parent = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    front = np.array(sorted(set(seeds)), np.int64)
    depth[front] = 0
    level = 0
    while len(front) and (max_depth is None or level < max_depth):
        size = offs[front + 1] - offs[front]
        at = np.repeat(offs[front] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        to, by = targets[at], np.repeat(front, size)
        fresh = depth[to] < 0
        to, by = to[fresh], by[fresh]
        if not len(to):
            break
        big = np.full(n, n, np.int64)
        np.minimum.at(big, to, by)
        front = np.unique(to)
        level += 1
        depth[front], parent[front] = level, big[front]
    return depth, parent


def bfs(edges: DataFrame, start: str, max_depth: int = 100, direction: str = "forward", local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, depth, parent): every reached node once at its least depth; the start is there even if no edge has it.

    parent is the least id among the neighbours one level up, null for the start.
    """
    check_direction(direction)
    spark = edges.sparkSession
    edges = held(edges.select("src", "dst", "weight"))
    first = spark.createDataFrame([(str(start), 0, None)], _REACH)
    if is_small(edges, local_arcs):

        def walk(g: Graph) -> pd.DataFrame:
            s = g.id_of(str(start))
            if s < 0:
                return pd.DataFrame({"node": [], "depth": [], "parent": []})
            offs, to, _ = g.csr(direction)
            depth, parent = reach(offs, to, [s], g.n, max_depth)
            at = np.flatnonzero(depth > 0)
            return pd.DataFrame({"node": g.names[at], "depth": depth[at].astype(np.int32), "parent": g.names[parent[at]]})

        return first.unionAll(in_one_task(edges, walk, _REACH))
    hops = arcs(edges, direction).select("src", "dst")
    done = front = checkpointed(first)
    size = 1
    for level in range(1, max_depth + 1):
        # a small front goes to the arcs, which then don't move
        front = F.broadcast(front) if size <= _FRONT else front
        step = front.select(F.col("node").alias("src")).join(hops, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = checkpointed(step.join(done, "node", "left_anti").select("node", F.lit(level).alias("depth"), "parent"))
        size = front.count()
        if not size:
            break
        done = done.unionAll(front)
    return done


def dfs(edges: DataFrame, start: str, max_depth: int = 100, direction: str = "forward", local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, depth, parent, visit): preorder with an explicit stack, later arcs first; depth is that of the path taken.

    The order is sequential by definition, so the part of the graph that the start reaches has to be small.
    """
    check_direction(direction)
    schema = _REACH + ", visit int"
    spark = edges.sparkSession
    edges = held(edges)
    if not is_small(edges, local_arcs):
        seen = bfs(edges, start, 1 << 30, direction, local_arcs).select("node")
        edges = edges.join(seen.withColumnRenamed("node", "src"), "src", "left_semi").join(seen.withColumnRenamed("node", "dst"), "dst", "left_semi")
        if not is_small(edges, local_arcs):
            raise ValueError(f"depth-first order of more than {local_arcs} arcs is sequential; restrict the edges")

    def walk(g: Graph) -> pd.DataFrame:
        s = g.id_of(str(start))
        return pd.DataFrame(preorder(g, s, max_depth, direction)[1:] if s >= 0 else [], columns=["node", "depth", "parent", "visit"])

    return spark.createDataFrame([(str(start), 0, None, 0)], schema).unionAll(in_one_task(edges, walk, schema))


def preorder(g: Graph, s: int, max_depth: int, direction: str) -> list[tuple]:
    """(node, depth, parent, visit) from node s."""
    out: list[tuple] = []
    offs, to, _ = g.csr(direction)
    seen = np.zeros(g.n, bool)
    stack = [(s, 0, -1)]
    while stack:
        v, d, p = stack.pop()
        if seen[v]:
            continue
        seen[v] = True
        out.append((g.names[v], d, g.names[p] if p >= 0 else None, len(out)))
        if d < max_depth:
            stack += [(t, d + 1, v) for t in to[offs[v] : offs[v + 1]].tolist() if not seen[t]]
    return out


def one_path(g: Graph, start: str, end: str, weighted: bool, direction: str) -> pd.DataFrame:
    s, e = g.id_of(start), g.id_of(end)
    none = pd.DataFrame({"node": [], "distance": [], "path_order": []})
    if start == end:
        return pd.DataFrame({"node": [start], "distance": [0.0], "path_order": [0]})
    if s < 0 or e < 0:
        return none
    if weighted:
        dist, parent = dijkstra(*g.csr(direction, "min"), s, g.n)
    else:
        offs, to, _ = g.csr(direction)
        depth, parent = reach(offs, to, [s], g.n, None)
        dist = np.where(depth < 0, np.inf, depth).astype(float)
    if not np.isfinite(dist[e]):
        return none
    path = [e]
    while path[-1] != s:
        path.append(int(parent[path[-1]]))
    path = path[::-1]
    return pd.DataFrame({"node": g.names[path], "distance": dist[path], "path_order": np.arange(len(path), dtype=np.int32)})


def rank_nodes(g: Graph, damping: float, iterations: int) -> np.ndarray:
    out = np.bincount(g.src, minlength=g.n)
    r = np.full(g.n, 1.0 / max(g.n, 1))
    for _ in range(iterations):
        share = r / np.maximum(out, 1)
        r = (1 - damping) / g.n + damping * (np.bincount(g.dst, share[g.src], g.n) + r[out == 0].sum() / g.n)
    return r


def shortest_path(edges: DataFrame, start: str, end: str, weighted: bool = False, direction: str = "forward", local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, distance, path_order) of one shortest path; no rows if there is none, one row if start is end.

    Of equal paths the one whose nodes, read from the end, have the least ids is taken. Weights must not be negative.
    """
    check_direction(direction)
    spark = edges.sparkSession
    edges = edges.select("src", "dst", "weight")
    start, end = str(start), str(end)
    if start == end:
        return spark.createDataFrame([(start, 0.0, 0)], _PATH)
    edges = held(edges)
    if weighted and not edges.where("weight < 0").isEmpty():
        raise ValueError("negative weights have no shortest path here")
    if is_small(edges, local_arcs):

        return in_one_task(edges, lambda g: one_path(g, start, end, weighted, direction), _PATH)
    hops = arcs(edges, direction).withColumn("weight", F.col("weight") if weighted else F.lit(1.0)).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    best = front = checkpointed(spark.createDataFrame([(start, 0.0)], "node string, dist double"))
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "src").join(hops, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("near"))
        both = best.join(step, "node", "full_outer")
        nxt = checkpointed(both.select("node", F.least("dist", "near").alias("dist"), (F.col("dist").isNull() | (F.col("near") < F.col("dist"))).alias("new")))
        best, front = nxt.select("node", "dist"), nxt.where("new").select("node", "dist")
        if not weighted and not front.where(F.col("node") == end).isEmpty():
            break
    rows: list[tuple[str, float]] = []
    at = best.where(F.col("node") == end).first()
    while at is not None:
        rows.append((at["node"], at["dist"]))
        if at["node"] == start:
            break
        back = hops.where(F.col("dst") == at["node"]).join(best.withColumnRenamed("node", "src"), "src")
        at = back.where(F.abs(F.col("dist") + F.col("weight") - F.lit(at["dist"])) < 1e-10).orderBy("src").select(F.col("src").alias("node"), "dist").first()
    return spark.createDataFrame([(n, d, i) for i, (n, d) in enumerate(reversed(rows))], _PATH)


def dijkstra(offs: np.ndarray, to: np.ndarray, w: np.ndarray, s: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, least parent on a shortest path)."""
    dist, parent = np.full(n, np.inf), np.full(n, -1, np.int64)
    dist[s] = 0.0
    heap, done = [(0.0, s)], np.zeros(n, bool)
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        for i in range(offs[v], offs[v + 1]):
            t, x = int(to[i]), d + w[i]
            if x < dist[t] - 1e-10:
                dist[t], parent[t] = x, v
                heapq.heappush(heap, (x, t))
            elif abs(x - dist[t]) <= 1e-10 and t != s and v < parent[t]:
                parent[t] = v
    return dist, parent


def component_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Least index of each component, by hooking and pointer jumping on arrays."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[src], label[dst])
        nxt = label.copy()
        np.minimum.at(nxt, label[src], low)
        np.minimum.at(nxt, label[dst], low)
        while (jump := nxt[nxt] != nxt).any():
            nxt = np.where(jump, nxt[nxt], nxt)
        if (nxt == label).all():
            return label
        label = nxt


def components(edges: DataFrame, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, component_id, component_size): weakly connected; component_id is 0-based in order of the least node ids.

    Large graphs use alternating hooking and pointer jumping, so the number of rounds grows with the logarithm
    of the diameter.
    """
    edges = held(edges.select("src", "dst", "weight"))
    schema = "node string, component_id bigint, component_size bigint"
    if is_small(edges, local_arcs):

        def label(g: Graph) -> pd.DataFrame:
            _, at, size = np.unique(component_labels(g.src, g.dst, g.n), return_inverse=True, return_counts=True)
            return pd.DataFrame({"node": g.names, "component_id": at, "component_size": size[at]})

        return in_one_task(edges, label, schema)
    from loomkg.operators.edges import dense_index

    both = arcs(edges, "both").select("src", "dst").distinct()
    now = checkpointed(nodes(edges).select("node", F.col("node").alias("root")))
    while True:
        around = both.join(now.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        low = now.join(around, "node").select("node", "root", F.least("root", "near").alias("low"))
        hook = low.groupBy("root").agg(F.min("low").alias("hook"))
        hooked = low.join(hook, "root").select("node", "root", F.least("low", "hook").alias("nxt"))
        far = hooked.groupBy(F.col("root").alias("nxt")).agg(F.min("nxt").alias("far"))
        jumped = checkpointed(hooked.join(far, "nxt", "left").select("node", "root", F.least("nxt", F.coalesce("far", "nxt")).alias("nxt")))
        if jumped.where("root <> nxt").isEmpty():
            break
        now = jumped.select("node", F.col("nxt").alias("root"))
    sizes = dense_index(now.groupBy("root").agg(F.count("*").alias("component_size")), ["root"], "component_id")
    return now.join(sizes, "root").select("node", "component_id", "component_size")


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, rank): fixed iterations from 1/N; parallel arcs count; the mass of sinks spreads over all nodes.

    Arcs of a large graph are written once as pairs of numbers in buckets by source, so that rounds move only ranks.
    """
    edges = held(edges.select("src", "dst", "weight"))
    if is_small(edges, local_arcs):
        return in_one_task(edges, lambda g: pd.DataFrame({"node": g.names, "rank": rank_nodes(g, damping, iterations)}), "node string, rank double")
    from loomkg.operators.edges import dense_index

    spark = edges.sparkSession
    index = dense_index(nodes(edges), ["node"])
    n = index.count()
    ends = edges.join(index.select(F.col("node").alias("src"), F.col("idx").alias("s")), "src").join(index.select(F.col("node").alias("dst"), F.col("idx").alias("t")), "dst").select("s", "t")
    buckets, table, path = max(shuffle_partitions(spark), -(-edges.count() // _BUCKET)), f"loomkg_hops_{uuid.uuid4().hex}", new_path(spark, "hops")
    ends.repartition(buckets, "s").write.bucketBy(buckets, "s").option("path", path).format("parquet").saveAsTable(table)
    hops = spark.table(table)
    now = index.select("idx").join(hops.groupBy("s").agg(F.count("*").alias("deg")), F.col("idx") == F.col("s"), "left")
    now = checkpointed(now.select("idx", "deg", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(iterations):
        lost = now.where("deg IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        give = now.where("deg IS NOT NULL").select(F.col("idx").alias("s"), (F.col("rank") / F.col("deg")).alias("share"))
        got = hops.join(give.hint("shuffle_hash"), "s").groupBy("t").agg(F.sum("share").alias("in"))
        both = now.join(got, F.col("idx") == F.col("t"), "left").crossJoin(F.broadcast(lost))
        now = checkpointed(both.select("idx", "deg", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_path(spark, path)
    return now.join(index, "idx").select("node", "rank")
