"""Knowledge-graph plans: incremental extraction, retrieval, seed-expand-prune."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkg.operators.edges import canonical
from loomkg.operators.selector import reach_from


class Dag:
    """Phases with dependencies and staleness tests; those that are ready run side by side."""

    def __init__(self) -> None:
        self.phases: dict[str, tuple[Callable[[], None], tuple[str, ...], Callable[[], bool]]] = {}

    def add(self, name: str, run: Callable[[], None], after: tuple[str, ...] = (), stale: Callable[[], bool] = lambda: True) -> None:
        for a in after:
            if a not in self.phases:
                raise ValueError(f"unknown phase: {a}")
        self.phases[name] = (run, after, stale)

    def run(self, workers: int = 4) -> list[str]:
        """Names of the phases that ran, a phase also if one before it did."""
        ran: list[str] = []
        done: set[str] = set()
        with ThreadPoolExecutor(workers) as pool:
            while len(done) < len(self.phases):
                ready = [n for n, (_, after, _) in self.phases.items() if n not in done and set(after) <= done]
                todo = [n for n in ready if self.phases[n][2]() or set(self.phases[n][1]) & set(ran)]
                list(pool.map(lambda n: self.phases[n][0](), todo))
                ran += todo
                done |= set(ready)
        return ran


def pending(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks that are not in the log yet."""
    return chunks.join(log.select("chunk_id").distinct(), "chunk_id", "left_anti")


def entities_of(extracted: DataFrame) -> DataFrame:
    """(chunk_id, name, entity_type, confidence) of (chunk_id, x)."""
    e = extracted.select("chunk_id", F.explode("x.entities").alias("e"))
    return e.select("chunk_id", F.col("e.text").alias("name"), F.col("e.type").alias("entity_type"), F.col("e.score").alias("confidence"))


def relations_of(extracted: DataFrame) -> DataFrame:
    """(chunk_id, src, dst, rel_type, weight): no self-relations, weight is the mean confidence."""
    r = extracted.select("chunk_id", F.explode("x.relations").alias("r")).where("r.head <> r.tail")
    return r.groupBy("chunk_id", F.col("r.head").alias("src"), F.col("r.tail").alias("dst"), F.col("r.rel").alias("rel_type")).agg(F.avg("r.score").alias("weight"))


def embedding_map(names: DataFrame, known: DataFrame) -> DataFrame:
    """(rowid, name): new distinct names numbered after the largest known rowid."""
    from loomkg.operators.edges import dense_index

    fresh = names.select("name").distinct().join(known, "name", "left_anti")
    top = known.agg(F.coalesce(F.max("rowid"), F.lit(0)).alias("top"))
    return dense_index(fresh, ["name"], "at").crossJoin(F.broadcast(top)).select((F.col("at") + F.col("top") + 1).cast("bigint").alias("rowid"), "name")


def retrieve(seeds: DataFrame, chunk_entities: DataFrame, relations: DataFrame, depth: int = 1) -> DataFrame:
    """(qid, id): chunks that share an entity with the seeds' entities, expanded `depth` steps forward. seeds: (qid, id)."""
    start = seeds.join(chunk_entities.select(F.col("chunk_id").alias("id"), "name"), "id").select("qid", F.col("name").alias("node")).distinct()
    hops = relations.select(F.col("src").alias("node"), F.col("dst").alias("nxt")).distinct()
    seen = front = start
    for _ in range(depth):
        front = front.join(hops, "node").select("qid", F.col("nxt").alias("node")).distinct()
        seen = seen.unionAll(front)
    return seen.distinct().join(chunk_entities.select("chunk_id", F.col("name").alias("node")), "node").select("qid", F.col("chunk_id").alias("id")).distinct()


def simple_graph(edges: DataFrame) -> DataFrame:
    """Duplicate edges summed, self-loops dropped."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def seeds_by(edges: DataFrame, score: DataFrame, top: int) -> DataFrame:
    """(node): the best `top` of (node, centrality), ties by node."""
    return score.orderBy(F.col("centrality").desc(), "node").limit(top).select("node")


def seed_expand_prune(edges: DataFrame, seeds: DataFrame, depth: int = 1, min_degree: int = 1) -> DataFrame:
    """(src, dst, weight) among nodes within `depth` undirected steps of a seed (0: whole components), nodes of a lower induced degree pruned once."""
    g = simple_graph(edges)
    kept = reach_from(g, seeds, "both", depth if depth > 0 else -1).select("node")

    def among(e: DataFrame, n: DataFrame) -> DataFrame:
        return e.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")

    inside = among(g, kept)
    deg = inside.select(F.col("src").alias("node")).unionAll(inside.select("dst")).groupBy("node").agg(F.count("*").alias("d")).where(F.col("d") >= min_degree).select("node")
    return among(inside, deg).select("src", "dst", "weight")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value of each key, ties by value."""
    by = Window.partitionBy(key).orderBy(F.col("n").desc(), value)
    return rows.groupBy(key, value).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(by)).where("r = 1").select(key, value)


def embed_points(projection: DataFrame, labels: DataFrame) -> DataFrame:
    """Projected points with their labels where there are any."""
    return projection.join(labels, "id", "left")


def project(vectors: DataFrame, k: int = 2, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, point array<double>): principal components, a linear stand-in for neighbourhood projections."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("__v"))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(v).transform(v).select(id_col, vector_to_array("__p").alias("point"))


_ = canonical
