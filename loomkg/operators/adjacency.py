"""Adjacency cache: versioned tables of a graph, kept up to date from a log of edge changes.

    nodes (idx, node)   degree (node, in, out, weighted)   arcs (src, dst, weight, seq)   blocks of CSR
Each rebuild writes a new version folder and then moves the pointer, so a lost job leaves the old version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkg.common import drop_path
from loomkg.operators.edges import dense_index

BLOCK = 4096
INSERT, DELETE = 1, 2


def degrees(arcs: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, weighted_in_degree, weighted_out_degree) from (src, dst, weight)."""
    z, o = F.lit(0), F.lit(1)
    outs = arcs.select(F.col("src").alias("node"), z.alias("i"), o.alias("o"), F.lit(0.0).alias("wi"), F.col("weight").alias("wo"))
    ins = arcs.select(F.col("dst").alias("node"), o.alias("i"), z.alias("o"), F.col("weight").alias("wi"), F.lit(0.0).alias("wo"))
    names = {"i": "in_degree", "o": "out_degree", "wi": "weighted_in_degree", "wo": "weighted_out_degree"}
    return outs.unionAll(ins).groupBy("node").agg(*[F.sum(c).alias(n) for c, n in names.items()])


def apply_delta(arcs: DataFrame, delta: DataFrame) -> DataFrame:
    """(src, dst, weight, seq) after the changes (src, dst, weight, op, seq), in the order of seq.

    A delete removes the oldest arc with its ends that is still there, whatever the weight; without one it does nothing.
    Per pair of ends it is a queue: the arcs that remain are the last ones, as many as the queue's final length.
    """
    log = arcs.select("src", "dst", "weight", "seq", F.lit(INSERT).alias("op"), F.lit(0).alias("late")).unionByName(delta.select("src", "dst", "weight", "seq", "op", F.lit(1).alias("late")))
    step = F.when(F.col("op") == INSERT, 1).otherwise(-1)
    by = Window.partitionBy("src", "dst").orderBy("late", "seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("src", "dst")
    walk = F.sum(step).over(by)
    kept = log.withColumn("walk", walk).withColumn("low", F.least(F.lit(0), F.min("walk").over(whole))).withColumn("total", F.sum(step).over(whole) - F.col("low"))
    adds = kept.where(F.col("op") == INSERT)
    newest = Window.partitionBy("src", "dst").orderBy(F.col("late").desc(), F.col("seq").desc())
    return adds.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= F.col("total")).select("src", "dst", "weight", "seq")


def csr_blocks(arcs: DataFrame, index: DataFrame, reverse: bool = False) -> DataFrame:
    """(block_id, offsets, targets, weights): CSR in blocks of 4096 nodes; targets are global indices."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    s = arcs.join(index.select(F.col("node").alias(a), F.col("idx").alias("s")), a).join(index.select(F.col("node").alias(b), F.col("idx").alias("t")), b)
    block = F.floor(F.col("s") / BLOCK).cast("int")
    rows = s.groupBy(block.alias("block_id"), "s").agg(F.array_sort(F.collect_list(F.struct("seq", "t", "weight"))).alias("a"))
    every = index.select(F.floor(F.col("idx") / BLOCK).cast("int").alias("block_id"), F.col("idx").alias("s"))
    full = every.join(rows, ["block_id", "s"], "left").withColumn("a", F.coalesce("a", F.array().cast(rows.schema["a"].dataType)))
    packed = full.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("s", "a"))).alias("x"))
    sizes = F.transform("x", lambda e: F.size(e["a"]))
    offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    flat = F.flatten(F.transform("x", lambda e: e["a"]))
    return packed.select("block_id", offsets.alias("offsets"), F.transform(flat, lambda e: e["t"].cast("int")).alias("targets"), F.transform(flat, lambda e: e["weight"]).alias("weights"))


class AdjacencyCache:
    """create / ensure_fresh / rebuild / incremental_rebuild / table over a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str, edges: DataFrame) -> AdjacencyCache:
        """edges: (src, dst, weight[, edge_seq])."""
        cache = cls(spark, path)
        cache.rebuild(edges)
        return cache

    def _pointer(self) -> dict:
        rows = self.spark.read.text(f"{self.path}/pointer").collect()
        return max((json.loads(r.value) for r in rows), key=lambda x: x["generation"])

    @property
    def generation(self) -> int:
        return self._pointer()["generation"]

    def table(self, name: str) -> DataFrame:
        """nodes, degree, arcs, csr_fwd or csr_rev of the current version."""
        return self.spark.read.parquet(f"{self.path}/v{self.generation}/{name}")

    def _save(self, arcs: DataFrame, index: DataFrame, generation: int) -> None:
        base = f"{self.path}/v{generation}"
        arcs.write.mode("overwrite").parquet(f"{base}/arcs")
        index.write.mode("overwrite").parquet(f"{base}/nodes")
        arcs, index = self.spark.read.parquet(f"{base}/arcs"), self.spark.read.parquet(f"{base}/nodes")
        d = index.join(degrees(arcs), "node", "left").select("node", F.col("idx").alias("node_idx"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("weighted_in_degree", "weighted_out_degree")])
        d.write.mode("overwrite").parquet(f"{base}/degree")
        for name, reverse in (("csr_fwd", False), ("csr_rev", True)):
            csr_blocks(arcs, index, reverse).write.mode("overwrite").parquet(f"{base}/{name}")
        self.spark.createDataFrame([(json.dumps({"generation": generation, "edges": arcs.count()}),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/pointer")

    def rebuild(self, edges: DataFrame, generation: int | None = None) -> None:
        if generation is None:
            try:
                generation = self.generation + 1
            except Exception:  # noqa: BLE001
                generation = 1
        if "edge_seq" in edges.columns:
            arcs = edges.select("src", "dst", "weight", F.col("edge_seq").alias("seq"))
        else:
            arcs = dense_index(edges.select("src", "dst", "weight"), ["src", "dst", "weight"], "seq")
        seen = arcs.select(F.col("src").alias("node"), (F.col("seq") * 2).alias("at")).unionAll(arcs.select("dst", F.col("seq") * 2 + 1)).groupBy("node").agg(F.min("at").alias("at"))
        self._save(arcs, dense_index(seen, ["at"]).select("node", "idx"), generation)

    def incremental_rebuild(self, delta: DataFrame) -> None:
        """delta: (src, dst, weight, op, seq). New nodes get the next indices; old ones keep theirs."""
        now = apply_delta(self.table("arcs"), delta)
        nodes = self.table("nodes")
        seen = delta.where(F.col("op") == INSERT).select(F.col("src").alias("node"), (F.col("seq") * 2).alias("at")).unionAll(delta.where(F.col("op") == INSERT).select("dst", F.col("seq") * 2 + 1))
        fresh = seen.groupBy("node").agg(F.min("at").alias("at")).join(nodes, "node", "left_anti")
        top = nodes.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("top"))
        more = dense_index(fresh, ["at"]).crossJoin(F.broadcast(top)).select("node", (F.col("idx") + F.col("top")).alias("idx"))
        self._save(now, nodes.unionByName(more), self.generation + 1)

    def ensure_fresh(self, delta: DataFrame, edges: DataFrame) -> str:
        """clean, incremental (at most max(10, a tenth of the edges) changes) or full."""
        n = delta.count()
        if not n:
            return "clean"
        if n <= max(10, self._pointer()["edges"] // 10):
            self.incremental_rebuild(delta)
            return "incremental"
        self.rebuild(edges)
        return "full"

    def command(self, name: str, edges: DataFrame | None = None, delta: DataFrame | None = None) -> None:
        if name == "rebuild":
            self.rebuild(edges)
        elif name == "incremental_rebuild":
            self.incremental_rebuild(delta)
        elif name != "stats":
            raise ValueError(f"unknown command: {name}")

    def node(self, name: str) -> DataFrame:
        return self.table("degree").where(F.col("node") == name)

    def drop(self) -> None:
        drop_path(self.spark, self.path)
