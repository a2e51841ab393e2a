"""Community detection: sequential Leiden, a multilevel mode, and modularity of a given assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.operators.edges import Graph, arcs, check_direction, held, in_one_task, is_small


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of an assignment (node, community_id): two aggregations, at any size.

    Q = sum over communities of [inside / 2m - resolution (total / 2m)^2], degrees counted in both directions.
    """
    both = arcs(held(edges), "both")
    a = membership.select(F.col("node").alias("src"), F.col("community_id").alias("ca"))
    b = membership.select(F.col("node").alias("dst"), F.col("community_id").alias("cb"))
    per = both.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum("weight").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    sums = per.agg(F.sum("tot").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("t2"))
    return sums.select(F.when(F.col("m2") > 0, F.col("i") / F.col("m2") - resolution * F.col("t2") / (F.col("m2") * F.col("m2"))).otherwise(0.0).alias("modularity"))


#: Arcs that one task sweeps: some minutes, and memory by the arrays of the graph.
LEIDEN_ARCS = 10_000_000


class _State:
    def __init__(self, g: Graph, direction: str, resolution: float) -> None:
        self.n, self.resolution = g.n, resolution
        offs, self.to, self.w = g.csr("both" if direction == "both" else "forward" if direction == "forward" else "reverse")
        self.offs = offs.tolist()
        self.k = [float(sum(x for _, x in self.near(v))) for v in range(g.n)]
        self.m = float(np.array(self.k).sum()) / 2

    def near(self, v: int) -> zip:
        """(node, weight) of the arcs of v; as arrays, since pairs in Python would be many times larger."""
        a, b = self.offs[v], self.offs[v + 1]
        return zip(self.to[a:b].tolist(), self.w[a:b].tolist(), strict=True)

    def quality(self, comm: list[int]) -> float:
        if self.m <= 0:
            return 0.0
        inside, tot = {}, {}
        for v in range(self.n):
            c = comm[v]
            tot[c] = tot.get(c, 0.0) + self.k[v]
            inside[c] = inside.get(c, 0.0) + sum(w for t, w in self.near(v) if comm[t] == c)
        m2 = 2 * self.m
        return float(sum(inside[c] / m2 - self.resolution * (tot[c] / m2) ** 2 for c in tot))

    def move(self, comm: list[int], within: list[int] | None = None) -> bool:
        """Sweep in node order until nothing moves; the first best strictly positive gain wins."""
        tot: dict[int, float] = {}
        for v in range(self.n):
            tot[comm[v]] = tot.get(comm[v], 0.0) + self.k[v]
        any_move = False
        while True:
            moved = False
            for v in range(self.n):
                link: dict[int, float] = {}
                own = comm[v]
                for t, w in self.near(v):
                    if t != v and (within is None or within[t] == within[v]):
                        link[comm[t]] = link.get(comm[t], 0.0) + w
                to_own, best, where = link.get(own, 0.0), 0.0, own
                kv = self.k[v]
                for c, w in link.items():
                    if c != own:
                        gain = (w - to_own) / self.m + self.resolution * kv * (tot[own] - kv - tot.get(c, 0.0)) / (2 * self.m**2)
                        if gain > best + 1e-12:
                            best, where = gain, c
                if where != own:
                    tot[own] -= kv
                    tot[where] = tot.get(where, 0.0) + kv
                    comm[v] = where
                    moved = any_move = True
            if not moved:
                return any_move


def _numbered(comm: list[int]) -> list[int]:
    ids: dict[int, int] = {}
    return [ids.setdefault(c, len(ids)) for c in comm]


def leiden_local(g: Graph, resolution: float, direction: str) -> tuple[list[int], float]:
    """Local moving, then refinement inside communities, kept only if it doesn't add communities; at most 100 rounds."""
    s = _State(g, direction, resolution)
    comm = list(range(g.n))
    if s.m <= 0 or direction == "reverse":
        return comm, 0.0
    for _ in range(100):
        moved = s.move(comm)
        fine = list(range(g.n))
        s.move(fine, within=list(comm))
        if len(set(fine)) <= len(set(comm)):
            comm = fine
        comm = _numbered(comm)
        if not moved:
            break
    comm = _numbered(comm)
    return comm, s.quality(comm)


def leiden_multilevel(g: Graph, resolution: float, direction: str) -> tuple[list[int], float]:
    """The same moves with aggregation of communities between the levels."""
    top = _State(g, direction, resolution)
    comm = list(range(g.n))
    if top.m <= 0 or direction == "reverse":
        return comm, 0.0
    level = g
    while True:
        s = _State(level, direction, resolution)
        part = list(range(level.n))
        if not s.move(part):
            break
        part = _numbered(part)
        comm = [part[c] for c in comm]
        p = np.array(part)
        level = Graph(np.arange(max(part) + 1).astype(object), p[level.src], p[level.dst], level.weight)
        if level.n == len(part):
            break
    comm = _numbered(comm)
    return comm, top.quality(comm)


def leiden(edges: DataFrame, resolution: float = 1.0, direction: str = "both", mode: str = "local", local_arcs: int = LEIDEN_ARCS) -> DataFrame:
    """(node, community_id, modularity): ids are contiguous in order of first appearance, modularity is that of the whole.

    The sweep is sequential by definition, so one task runs it on a graph of checked size. Larger graphs have
    `label_communities`, which is distributed.
    """
    return _leiden(held(edges), resolution, direction, mode, local_arcs)


def _leiden(edges: DataFrame, resolution: float, direction: str = "both", mode: str = "local", local_arcs: int = LEIDEN_ARCS) -> DataFrame:
    check_direction(direction)
    if mode not in ("local", "multilevel"):
        raise ValueError("mode is local or multilevel")
    if not is_small(edges, local_arcs):
        raise ValueError(f"more than {local_arcs} arcs: use label_communities, or raise local_arcs if one task can hold them")
    run = leiden_local if mode == "local" else leiden_multilevel

    def solve(g: Graph) -> pd.DataFrame:
        comm, q = run(g, resolution, direction)
        return pd.DataFrame({"node": g.names, "community_id": np.array(comm, np.int64), "modularity": q})

    return in_one_task(edges, solve, "node string, community_id bigint, modularity double")


def label_communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, community_id): weighted label propagation with least-label ties; for graphs beyond one task.

    Labels only ever fall, so it ends; an error if they still fall after `rounds`.
    """
    from loomkg.common import checkpointed
    from loomkg.operators.edges import dense_index, nodes

    both = checkpointed(arcs(edges, "both").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    now = checkpointed(nodes(edges).select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        votes = both.join(now.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select(F.col("src").alias("node"), F.col("b.label").alias("nxt"))
        joined = checkpointed(now.join(best, "node", "left").select("node", "label", F.least("label", F.coalesce("nxt", "label")).alias("nxt")))
        if joined.where("label <> nxt").isEmpty():
            break
        now = joined.select("node", F.col("nxt").alias("label"))
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    ids = dense_index(now.select("label").distinct(), ["label"], "community_id")
    return now.join(ids, "label").select("node", "community_id")


def multi_resolution(edges: DataFrame, resolutions: tuple[float, ...] = (0.25, 1.0, 3.0), **options) -> DataFrame:
    """(node, resolution, community_id, modularity) for each resolution; the edges are evaluated once for all."""
    edges = held(edges)
    out = None
    for r in resolutions:
        part = _leiden(edges, r, **options).select("node", F.lit(float(r)).alias("resolution"), "community_id", "modularity")
        out = part if out is None else out.unionByName(part)
    return out


def representatives(membership: DataFrame, score: DataFrame, top: int = 1) -> DataFrame:
    """(community_id, node, centrality, rank): the best nodes of each community, ties by node."""
    from pyspark.sql import Window

    by = Window.partitionBy("community_id").orderBy(F.col("centrality").desc(), "node")
    return membership.select("node", "community_id").join(score.select("node", "centrality"), "node").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("community_id", "node", "centrality", "rank")
