"""Entity resolution: blocking by nearest neighbours, scoring, clustering, canonical forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkg.common import ship
from loomkg.functions.text import jaro_winkler_udf
from loomkg.operators.centrality import edge_betweenness
from loomkg.operators.community import leiden
from loomkg.operators.traverse import components
from loomkg.operators.vector import knn

GUARDS = (None, "same_source", "diff_type")


def blocking(entities: DataFrame, k: int, dist_threshold: float, metric: str = "cosine") -> DataFrame:
    """(a, b, dist): unordered pairs of the k + 1 nearest within the threshold. entities: (entity_id, vector, ...)."""
    v = entities.select(F.col("entity_id").alias("id"), "vector")
    near = knn(v, v.withColumnRenamed("id", "qid"), k + 1, metric, self_join=False)
    pairs = near.where((F.col("qid") != F.col("id")) & (F.col("distance") <= dist_threshold))
    return pairs.groupBy(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).agg(F.min("distance").alias("dist"))


def score_pairs(pairs: DataFrame, entities: DataFrame, jw_weight: float = 0.4, type_guard: str | None = None, equal_case: float = 0.9) -> DataFrame:
    """(a, b, dist, score). Equal names score 1, names equal but for case 0.9, others w jw + (1 - w)(1 - dist).

    Guard same_source skips pairs of one source, diff_type pairs of different sources; an empty source disables it.
    """
    if type_guard not in GUARDS:
        raise ValueError(f"unknown type guard: {type_guard}")
    ship(pairs.sparkSession)
    src = F.col("source") if "source" in entities.columns else F.lit("")
    e = entities.select("entity_id", "name", F.coalesce(src, F.lit("")).alias("source"))
    joined = pairs.join(e.select(F.col("entity_id").alias("a"), F.col("name").alias("na"), F.col("source").alias("sa")), "a").join(e.select(F.col("entity_id").alias("b"), F.col("name").alias("nb"), F.col("source").alias("sb")), "b")
    known = (F.col("sa") != "") & (F.col("sb") != "")
    if type_guard == "same_source":
        joined = joined.where(~(known & (F.col("sa") == F.col("sb"))))
    elif type_guard == "diff_type":
        joined = joined.where(~(known & (F.col("sa") != F.col("sb"))))
    la, lb = F.lower("na"), F.lower("nb")
    mixed = jw_weight * jaro_winkler_udf(la, lb) + (1 - jw_weight) * (1 - F.col("dist"))
    return joined.select("a", "b", "dist", F.when(F.col("na") == F.col("nb"), 1.0).when(la == lb, equal_case).otherwise(mixed).alias("score"))


def resolve(entities: DataFrame, k: int, dist_threshold: float, jw_weight: float, borderline_delta: float = 0.0, type_guard: str | None = None, eb_threshold: float | None = None, metric: str = "cosine", cluster_by: str = "leiden") -> DataFrame:
    """(entity_id, cluster_id): a pair matches at score >= 1 - dist_threshold + borderline_delta; others get ids of their own.

    eb_threshold removes matches whose edge betweenness is larger, and clusters again.
    """
    scored = score_pairs(blocking(entities, k, dist_threshold, metric), entities, jw_weight, type_guard)
    match = scored.where(F.col("score") >= 1 - dist_threshold + borderline_delta).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.col("score").alias("weight"))
    from loomkg.common import written

    match = written(match, name="matches")

    def cluster(edges: DataFrame) -> DataFrame:
        if cluster_by == "components":
            return components(edges).select("node", F.col("component_id").alias("community_id"))
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        return leiden(both).select("node", "community_id")

    if eb_threshold is not None:
        bridges = edge_betweenness(match, "both").where(F.col("centrality") > eb_threshold).select("src", "dst")
        match = match.join(bridges, ["src", "dst"], "left_anti")
    found = cluster(match)
    ids = entities.select("entity_id").distinct()
    joined = ids.join(found, ids["entity_id"].cast("string") == found["node"], "left")
    # entities without a match follow the clusters, ordered by id
    from loomkg.operators.edges import dense_index

    alone = joined.where("community_id IS NULL").select("entity_id")
    top = found.agg(F.coalesce(F.max("community_id") + 1, F.lit(0)).alias("top"))
    single = dense_index(alone, ["entity_id"], "at").crossJoin(F.broadcast(top)).select("entity_id", (F.col("at") + F.col("top")).cast("bigint").alias("cluster_id"))
    return joined.where("community_id IS NOT NULL").select("entity_id", F.col("community_id").cast("bigint").alias("cluster_id")).unionByName(single)


def clusters_json(clusters: DataFrame) -> DataFrame:
    """One row {"clusters": {entity: cluster}}; a report, so it has to fit one row."""
    m = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("entity_id").cast("string"), "cluster_id"))))
    return clusters.agg(F.to_json(F.struct(m.alias("clusters"))).alias("json"))


def canonicalise(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """(name, canonical): the most mentioned name of each cluster, ties by name. mentions: (name, mention_count); clusters: (name, cluster_id)."""
    m = clusters.join(mentions.groupBy("name").agg(F.sum("mention_count").alias("n")), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "name")
    return m.withColumn("canonical", F.first("name").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select("name", "canonical")


def coalesce_nodes(mentions: DataFrame, canonical: DataFrame) -> DataFrame:
    """(name, entity_type, mention_count) of canonical nodes; the type is the most frequent one, ties by type."""
    m = mentions.join(canonical, "name", "left").withColumn("name", F.coalesce("canonical", "name"))
    t = m.groupBy("name", "entity_type").agg(F.sum("mention_count").alias("n"))
    by = Window.partitionBy("name").orderBy(F.col("n").desc(), "entity_type")
    total = Window.partitionBy("name")
    return t.withColumn("r", F.row_number().over(by)).withColumn("mention_count", F.sum("n").over(total)).where("r = 1").select("name", "entity_type", "mention_count")


def coalesce_edges(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """(src, dst, rel_type, weight): ends mapped, self-edges dropped, weights of equal edges summed."""
    a = canonical.select(F.col("name").alias("src"), F.col("canonical").alias("ca"))
    b = canonical.select(F.col("name").alias("dst"), F.col("canonical").alias("cb"))
    m = relations.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst"), "rel_type", "weight")
    return m.where("src <> dst").groupBy("src", "dst", "rel_type").agg(F.sum("weight").alias("weight"))
