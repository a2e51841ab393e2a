"""Clustering and extraction metrics, all as counts: no pair is ever materialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _common(pred: DataFrame, gold: DataFrame) -> DataFrame:
    return pred.select("id", F.col("cluster").alias("p")).join(gold.select("id", F.col("cluster").alias("g")), "id")


def bcubed(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(precision, recall, f1) over ids in both; (id, cluster) each."""
    c = _common(pred, gold).groupBy("p", "g").agg(F.count("*").alias("n"))
    p = c.groupBy("p").agg(F.sum("n").alias("np"))
    g = c.groupBy("g").agg(F.sum("n").alias("ng"))
    x = c.join(p, "p").join(g, "g")
    n = F.sum("n")
    s = x.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / n).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / n).alias("recall"))
    s = s.select(F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
    return s.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def pairwise(pred: DataFrame, gold: DataFrame, empty: float = 1.0) -> DataFrame:
    """(precision, recall, f1) over pairs of ids in both; `empty` where neither has a pair."""
    c = _common(pred, gold)

    def pairs(*cols: str) -> DataFrame:
        return c.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("x"))

    s = pairs("p", "g").withColumnRenamed("x", "tp").crossJoin(pairs("p").withColumnRenamed("x", "pp")).crossJoin(pairs("g").withColumnRenamed("x", "gp"))
    none = (F.col("pp") == 0) & (F.col("gp") == 0)
    s = s.select(none.alias("none"), F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0).alias("p"), F.when(F.col("gp") > 0, F.col("tp") / F.col("gp")).otherwise(0.0).alias("r"))
    out = s.select(*[F.when(F.col("none"), F.lit(empty)).otherwise(F.col(c)).alias(a) for c, a in (("p", "precision"), ("r", "recall"))], "none")
    return out.select("precision", "recall", F.when(F.col("none"), F.lit(empty)).otherwise(_f1(F.col("precision"), F.col("recall"))).alias("f1"))


def set_f1(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(precision, recall, f1) of two sets of rows, rounded to 4 digits; both empty give 0."""
    p, g = pred.distinct(), gold.distinct()
    one = [x.agg(F.count("*").alias(n)) for x, n in ((p.intersect(g), "tp"), (p, "np"), (g, "ng"))]
    s = one[0].crossJoin(one[1]).crossJoin(one[2])
    s = s.select(F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0).alias("precision"), F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(0.0).alias("recall"))
    return s.select(F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(_f1(F.col("precision"), F.col("recall")), 4).alias("f1"))


def retrieval_recall(found: DataFrame, relevant: DataFrame, n: int) -> DataFrame:
    """(qid, recall): found & relevant over min(relevant, n), with all that was found, so it may exceed 1."""
    rel = relevant.groupBy("qid").agg(F.count_distinct("id").alias("rel"))
    hit = found.select("qid", "id").distinct().join(relevant.select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hit"))
    return rel.join(hit, "qid", "left").select("qid", (F.coalesce("hit", F.lit(0)) / F.least("rel", F.lit(n))).alias("recall"))
