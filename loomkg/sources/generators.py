"""Random graphs of the usual kinds for benchmarks; both arcs of every edge are stored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _frame(spark: SparkSession, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> DataFrame:
    w = rng.uniform(0.1, 10.0, len(a)).round(3)
    return spark.createDataFrame(pd.DataFrame({"src": np.r_[a, b].astype(str), "dst": np.r_[b, a].astype(str), "weight": np.r_[w, w]}), "src string, dst string, weight double")


def random_pairs(spark: SparkSession, n: int, mean_degree: float, seed: int = 42) -> DataFrame:
    """Erdos-Renyi: as many distinct uniform pairs as the mean degree asks for."""
    rng = np.random.default_rng(seed)
    want = int(min(n * mean_degree / 2, n * (n - 1) / 2))
    key = np.zeros(0, np.int64)
    while len(key) < want:
        x, y = rng.integers(0, n, 2 * want), rng.integers(0, n, 2 * want)
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        key = np.unique(np.r_[key, (lo * n + hi)[lo < hi]])
    key = rng.permutation(key)[:want]
    return _frame(spark, key // n, key % n, rng)


def preferential(spark: SparkSession, n: int, m: int, seed: int = 42) -> DataFrame:
    """Barabasi-Albert: every new node joins m others drawn by degree."""
    rng = np.random.default_rng(seed)
    ends = list(range(m))
    a, b = [], []
    for v in range(m, n):
        near: set[int] = set()
        while len(near) < m:
            near.add(ends[int(rng.integers(len(ends)))])
        a += [v] * m
        b += near
        ends += [*near, *[v] * m]
    return _frame(spark, np.array(a), np.array(b), rng)
