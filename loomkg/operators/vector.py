"""Vector search: distances, exact nearest neighbours, an inverted-file index, recall."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkg.common import drop_path, ship

METRICS = ("l2", "cosine", "inner_product")
#: Queries that a task holds at most, vectors that it reads, and pairs that it is meant to compare.
QUERY_BLOCK, VECTOR_BLOCK, PAIRS = 1 << 16, 1 << 20, 1 << 33


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use l2, cosine or inner_product")
    return metric


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1 where a vector has no length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm < 1e-30, F.lit(1.0)).otherwise(1 - _dot(a, b) / norm)


def inner_product_distance(a: Column, b: Column) -> Column:
    """Negated dot product: less is closer."""
    return -_dot(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"l2": l2_distance, "cosine": cosine_distance, "inner_product": inner_product_distance}[check_metric(metric)](a, b)


def matrix_distance(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, vectors) in double."""
    dot = q @ x.T
    if metric == "inner_product":
        return -dot
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * dot, 0)
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
    return np.where(norm < 1e-30, 1.0, 1 - dot / np.maximum(norm, 1e-30))


def to_blob(vector: Column) -> Column:
    """Little-endian float32 bytes of an array."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def from_blob(blob: Column, dimensions: int) -> Column:
    """Array of a blob; a wrong length is an error."""

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> np.ndarray | None:
            if x is None:
                return None
            if len(x) != 4 * dimensions:
                raise ValueError(f"expected {4 * dimensions} bytes of vector, got {len(x)}")
            return np.frombuffer(x, "<f4")

        return b.map(one)

    return unpack(blob)


def _packed(df: DataFrame, id_col: str, vector_col: str, name: str, *more: str) -> tuple[DataFrame, str]:
    """(name, v, more) with the vectors as bytes, without null vectors; and the kind of number in them."""
    kind = "<f4" if df.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    id_kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), kind)
            ends = np.r_[0, np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False))].astype(np.int32) * flat.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.record_batch([b.column(0), blobs, *b.columns[2:]], [name, "v", *more])

    kept = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in more)
    return df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col, *more).mapInArrow(run, f"{name} {id_kind}, v binary{kept}"), kind


def _matrix(blobs: pa.Array, kind: str) -> np.ndarray:
    """Rows of equal length, in their own kind of number."""
    ends = np.frombuffer(blobs.buffers()[1], np.int64 if pa.types.is_large_binary(blobs.type) else np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    width = np.diff(ends)
    if (width != width[0]).any():
        size = np.dtype(kind).itemsize
        raise ValueError(f"expected {width[0] // size} dimensions, got {width[width != width[0]][0] // size}")
    data = blobs.buffers()[2]
    if data is None or not width[0]:
        return np.zeros((len(blobs), 0), kind)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(kind).reshape(len(blobs), -1)


def _names(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array([*ids.to_pylist(), None], object)[:-1]


class _Nearest:
    """The k nearest vectors of a block of queries, over vectors that come in the order of their ids.

    Products in float pick the pairs that may count, by a bound on the error; these are measured again in double and
    rounded to 9 digits. Equal ones are ties, so a later vector has to be strictly nearer. Where most pairs
    tie, or numbers are too large or small for float, the products themselves are in double. Memory is that of the
    block, its k best and one tile.
    """

    def __init__(self, metric: str, k: int, self_join: bool, names: list[pa.Array], queries: list[np.ndarray]) -> None:
        self.metric, self.k, self.self_join = metric, k, self_join
        self.names, self.q = pa.concat_arrays(names), np.concatenate(queries)
        n = len(self.q)
        self.own = _names(self.names) if self_join else None
        self.scale, self.q32, self.plain = self._ready(self.q, query=True)
        self.d, self.r, self.at = np.full((n, k), np.inf), np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.worst = np.full(n, np.inf)
        self.ids: list[pa.Array] = []
        self.seen = 0

    def _ready(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
        """(lengths, rows to multiply, whether float will do); rows that aren't finite become NaN, which is nobody's neighbour."""
        wide = x.astype(np.float64)
        wide[~np.isfinite(wide).all(1)] = np.nan
        with np.errstate(over="ignore"):
            length = np.sqrt((wide * wide).sum(1))
        some = length[length > 0]
        plain = not len(some) or bool(some.max() < 1e15 and (self.metric != "cosine" or some.min() > 1e-15))
        if not plain:
            return length, wide[:0].astype(np.float32), False
        if self.metric == "cosine":
            wide /= np.maximum(length, 1e-300)[:, None]
        elif self.metric == "l2":
            wide = np.c_[wide, np.ones(len(wide)) if query else -length * length / 2]
        return length, wide.astype(np.float32), plain

    def _floor(self, rows: slice, longest: float) -> np.ndarray:
        """The least product, in float, of a pair that may be among the best."""
        worst, length = self.worst[rows] + 1e-9, self.scale[rows]
        if self.metric == "cosine":
            at, size = 1 - worst, np.ones(len(worst))
        elif self.metric == "l2":
            at, size = (length * length - worst) / 2, length * longest + longest * longest
        else:
            at, size = -worst, length * longest
        with np.errstate(invalid="ignore"):
            at = at - (self.q.shape[1] + 8) * 2.0**-23 * size - np.abs(at) * 2.0**-22
        return np.where(np.isfinite(at), at, -np.inf).astype(np.float32)[:, None]

    def _measure(self, r: np.ndarray, c: np.ndarray, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        a, b = self.q[r].astype(np.float64), x[c].astype(np.float64)
        if self.metric == "l2":
            return np.square(a - b).sum(1)
        dot = np.einsum("ij,ij->i", a, b)
        if self.metric == "inner_product":
            return -dot
        norm = self.scale[r] * length[c]
        return np.where(norm < 1e-30, 1.0, 1 - dot / np.maximum(norm, 1e-30))

    def add(self, ids: pa.Array, x: np.ndarray) -> None:
        if x.shape[1] != self.q.shape[1]:
            raise ValueError(f"expected {self.q.shape[1]} dimensions, got {x.shape[1]}")
        self.ids.append(ids)
        own = _names(ids) if self.self_join else None
        length, x32, plain = self._ready(x)
        plain &= self.plain
        longest = float(np.nanmax(length, initial=0.0))
        lo = 0
        while lo < len(x):
            hi = min(len(x), lo + min(4096, max(64, self.seen)))
            some, held = [], 0
            for top in range(0, len(self.q), 256):
                rows = slice(top, min(top + 256, len(self.q)))
                hit = None
                if plain:
                    hit = np.flatnonzero(self.q32[rows] @ x32[lo:hi].T >= self._floor(rows, longest))
                if hit is None or (self.seen and len(hit) * 8 > (rows.stop - top) * (hi - lo)):
                    near = matrix_distance(self.metric, self.q[rows].astype(np.float64), x[lo:hi].astype(np.float64))
                    slack = 1e-12 + 1e-15 * self.q.shape[1] * ((self.scale[rows] + longest) ** 2 if self.metric != "cosine" else 1)
                    with np.errstate(invalid="ignore"):
                        hit = np.flatnonzero(near <= (self.worst[rows] - 0.5e-9 + slack)[:, None])
                r, c = np.divmod(hit, hi - lo)
                r += top
                c += lo
                step = max(1, (1 << 22) // max(1, x.shape[1]))
                for z in range(0, len(r), step):
                    rz, cz = r[z : z + step], c[z : z + step]
                    d = self._measure(rz, cz, x, length)
                    near = np.round(d, 9)
                    good = (near < self.worst[rz]) & np.isfinite(d)
                    if own is not None:
                        good &= self.own[rz] != own[cz]
                    some.append((rz[good], d[good], near[good], cz[good] - lo + self.seen))
                    held += len(some[-1][0])
                if held > 1 << 19:
                    self._merge(some)
                    some, held = [], 0
            self._merge(some)
            self.seen += hi - lo
            lo = hi

    def _merge(self, some: list[tuple]) -> None:
        if not some:
            return
        rows, d, near, at = (np.concatenate(x) for x in zip(*some, strict=True))
        if not len(rows):
            return
        u, n = np.unique(rows, return_counts=True)
        d, near, at = (np.concatenate([old[u].ravel(), new]) for old, new in ((self.d, d), (self.r, near), (self.at, at)))
        order = np.lexsort((at, near, np.concatenate([np.repeat(u, self.k), rows])))
        best = order[(np.cumsum(n + self.k) - n - self.k)[:, None] + np.arange(self.k)]
        self.d[u], self.r[u], self.at[u] = d[best], near[best], at[best]
        self.worst[u] = self.r[u, -1]

    def found(self) -> pa.RecordBatch | None:
        r, c = np.nonzero(np.isfinite(self.d))
        if not len(r):
            return None
        return pa.record_batch([self.names.take(pa.array(r)), pa.concat_arrays(self.ids).take(pa.array(self.at[r, c])), pa.array(self.d[r, c])], ["q", "i", "distance"])


def _blocks(queries: int, vectors: int, k: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of vectors: enough for all cores where there is work, and none larger than a task may hold."""
    pairs = queries * vectors
    cells = max(1, -(-pairs // PAIRS), min(2 * cores, pairs >> 22))
    a = max(1, -(-queries // max(1, min(QUERY_BLOCK, (1 << 22) // k))), round(math.sqrt(2 * cells * queries / max(1, vectors))))
    return a, max(1, -(-vectors // VECTOR_BLOCK), -(-cells // a))


def _search(queries: DataFrame, vectors: DataFrame, k: int, metric: str, kinds: tuple[str, str], layout: list[tuple[int, int, int]], self_join: bool = False) -> DataFrame:
    """(q, i, distance, rank) of the k nearest among the vectors of a query's cells. queries: (q, v, cell), vectors: (i, v, cell).

    layout has (cell, blocks of queries, blocks of vectors). Each block of queries meets each block of vectors of its
    cell in one task, queries first, then vectors by id.
    """
    spark = vectors.sparkSession
    starts = np.r_[0, np.cumsum([a * b for _, a, b in layout])].tolist()
    rows = F.broadcast(spark.createDataFrame([(c, at, a, b) for (c, a, b), at in zip(layout, starts[:-1], strict=True)], "cell int, __start int, __a int, __b int"))
    own = lambda name, n: F.pmod(F.xxhash64(name, "v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qkind, ikind = queries.schema["q"].dataType.simpleString(), vectors.schema["i"].dataType.simpleString()
    left = queries.join(rows, "cell").select("*", own("q", "__a").alias("__x"), each("__b").alias("__y"))
    right = vectors.join(rows, "cell").select("*", own("i", "__b").alias("__y"), each("__a").alias("__x"))
    task = (F.col("__start") + F.col("__x") * F.col("__b") + F.col("__y")).alias("task")
    both = left.select(task, F.lit(0).alias("side"), "q", F.lit(None).cast(ikind).alias("i"), "v").unionAll(right.select(task, F.lit(1).alias("side"), F.lit(None).cast(qkind).alias("q"), "i", "v"))
    placed = both.repartitionById(max(1, starts[-1]), F.col("task")).sortWithinPartitions("task", "side", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, held, best = -1, [], [], None
        for b in batches:
            at, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if at[lo] != task:
                    if best is not None and (out := best.found()) is not None:
                        yield out
                    task, names, held, best = at[lo], [], [], None
                x = _matrix(b.column(4).slice(lo, hi - lo), kinds[side[lo]])
                if not side[lo]:
                    names.append(b.column(2).slice(lo, hi - lo))
                    held.append(x)
                    if held[0].shape[1] != x.shape[1]:
                        raise ValueError(f"expected {held[0].shape[1]} dimensions, got {x.shape[1]}")
                elif names or best is not None:
                    if best is None:
                        best = _Nearest(metric, k, self_join, names, held)
                        names, held = [], []
                    best.add(b.column(3).slice(lo, hi - lo), x)
        if best is not None and (out := best.found()) is not None:
            yield out

    found = placed.mapInArrow(run, f"q {qkind}, i {ikind}, distance double")
    # distances are rounded before ranking so that equal ones tie by id whatever the order of the sums
    near = Window.partitionBy("q").orderBy(F.round("distance", 9), "i")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "qid", query_col: str = "vector", self_join: bool = False) -> DataFrame:
    """(query id, id, distance, rank) of the k exact nearest vectors of every query, ties by id.

    All pairs are compared, by blocks of queries and of vectors that meet in a task each; a task keeps its best k of
    each query and only those meet in an exchange. No query goes through the driver. self_join leaves out the pair
    of a vector with itself.
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be positive")
    ship(vectors.sparkSession)
    q, qkind = _packed(queries, query_id, query_col, "q")
    v, vkind = _packed(vectors, id_col, vector_col, "i")
    n = [d.where(F.col(c).isNotNull()).count() for d, c in ((queries, query_col), (vectors, vector_col))]
    layout = [(0, *_blocks(*n, k, vectors.sparkSession.sparkContext.defaultParallelism))]
    found = _search(q.withColumn("cell", F.lit(0)), v.withColumn("cell", F.lit(0)), k, metric, (qkind, vkind), layout, self_join)
    return found.select(F.col("q").alias(query_id), F.col("i").alias(id_col), "distance", "rank")


def recall_at_k(found: DataFrame, exact: DataFrame, query_id: str = "qid", id_col: str = "id") -> DataFrame:
    """(recall): mean share over queries of the exact neighbours that were found."""
    e = exact.select(query_id, id_col).distinct()
    hit = e.join(found.select(query_id, id_col).distinct().withColumn("hit", F.lit(1.0)), [query_id, id_col], "left")
    return hit.groupBy(query_id).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r")).agg(F.avg("r").alias("recall"))


@dataclass
class VectorIndex:
    """Inverted-file index in a folder: vectors by cell of their nearest centroid, deletions as a list of ids.

    Searching reads only the `probes` cells nearest to each query. Each change writes new files; nothing is
    rewritten but by compact().
    """

    spark: SparkSession
    path: str
    dimensions: int
    metric: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    cells: int = 64

    def __post_init__(self) -> None:
        if self.dimensions is None or self.dimensions < 1:
            raise ValueError("dimensions must be positive")
        check_metric(self.metric)
        if self.m < 2:
            raise ValueError("m must be at least 2")
        if self.ef_construction < 1:
            raise ValueError("ef_construction must be positive")
        self.centroids: np.ndarray | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, **options) -> VectorIndex:
        known = {"dimensions", "metric", "m", "ef_construction", "cells"}
        for o in options:
            if o not in known:
                raise ValueError(f"unknown parameter: {o}")
        if "dimensions" not in options:
            raise ValueError("dimensions is required")
        index = cls(spark, path, **options)
        index._save_config()
        return index

    def _save_config(self) -> None:
        row = (self.dimensions, self.metric, self.m, self.ef_construction, self.cells)
        self.spark.createDataFrame([row], "dimensions int, metric string, m int, ef_construction int, cells int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        c = spark.read.parquet(f"{path}/config").first()
        index = cls(spark, path, c.dimensions, c.metric, c.m, c.ef_construction, c.cells)
        try:
            rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        except AnalysisException as e:
            # nothing was inserted yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return index
        index.centroids = np.array([r.centroid for r in rows])
        return index

    def _vectors(self) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/vectors")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return None
            raise
        try:
            gone = self.spark.read.parquet(f"{self.path}/deleted")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return rows.drop("version")
        last = gone.groupBy("id").agg(F.max("version").alias("gone_at"))
        return rows.join(last, "id", "left").where(F.col("gone_at").isNull() | (F.col("version") > F.col("gone_at"))).drop("version", "gone_at")

    def rows(self) -> DataFrame:
        """(id, vector) of all that is live."""
        got = self._vectors()
        return self.spark.createDataFrame([], "id bigint, vector array<float>") if got is None else got.select("id", "vector")

    def _version(self) -> int:
        import time

        return time.time_ns()

    def _train(self, vectors: DataFrame) -> None:
        some = np.array([r.v for r in vectors.orderBy(F.xxhash64("id")).limit(20 * self.cells).select(F.col("vector").alias("v")).collect()], float)
        if not len(some):
            return
        rng = np.random.default_rng(42)
        x = some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-30) if self.metric == "cosine" else some
        c = x[rng.permutation(len(x))[: min(self.cells, len(x))]]
        for _ in range(10):
            near = matrix_distance("l2", x, c).argmin(1)
            c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        self.centroids = c
        spark = self.spark
        spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    def insert(self, vectors: DataFrame) -> int:
        """Append (id, vector); null ids continue after the largest; duplicates and wrong dimensions are errors. Gives the count."""
        if not vectors.where(F.col("vector").isNull() | (F.size("vector") != self.dimensions)).isEmpty():
            raise ValueError(f"expected vectors of {self.dimensions} dimensions")
        live = self.rows()
        named = vectors.where(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        free = vectors.where(F.col("id").isNull()).select(F.col("vector").cast("array<float>").alias("vector"))
        if not free.isEmpty():
            from loomkg.operators.edges import dense_index

            top = max(live.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], named.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
            named = named.unionByName(dense_index(free, ["vector"], "at").select((F.col("at") + top + 1).alias("id"), "vector"))
        if not named.groupBy("id").count().where("count > 1").isEmpty() or not named.join(live, "id", "left_semi").isEmpty():
            raise ValueError("duplicate id")
        if self.centroids is None:
            self._train(named)
        if self.centroids is None:
            return 0
        ship(self.spark)
        c, cos = self.spark.sparkContext.broadcast(self.centroids), self.metric == "cosine"

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) if cos else x
            return pd.Series(matrix_distance("l2", x, c.value).argmin(1).astype(np.int32))

        version = self._version()
        named.withColumn("cell", cell("vector")).withColumn("version", F.lit(version)).repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        return self.spark.read.parquet(f"{self.path}/vectors").where(F.col("version") == version).count()

    def delete(self, ids: list[int]) -> None:
        live = {r.id for r in self.rows().where(F.col("id").isin(ids)).select("id").collect()}
        for i in ids:
            if i not in live:
                raise ValueError(f"no such id: {i}")
        self.spark.createDataFrame([(i, self._version()) for i in ids], "id bigint, version bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/deleted")

    def update(self, *_args) -> None:
        raise ValueError("update is not supported; use delete and insert")

    def get(self, i: int) -> DataFrame:
        """(id, vector, distance 0) of one id."""
        return self.rows().where(F.col("id") == i).withColumn("distance", F.lit(0.0))

    def search(self, queries: DataFrame, k: int, ef_search: int | None = None, exact: bool = False) -> DataFrame:
        """(qid, id, distance, rank); ef_search, 2k by default, sets how many cells a query reads."""
        live = self._vectors()
        if live is None or self.centroids is None:
            return self.spark.createDataFrame([], "qid bigint, id bigint, distance double, rank int")
        if exact:
            return knn(live.select("id", "vector"), queries, k, self.metric)
        ef = max(k, 2 * k if ef_search is None else ef_search)
        probes = min(len(self.centroids), max(2, -(-ef * len(self.centroids) // 128)))
        ship(self.spark)
        c, cos, metric = self.spark.sparkContext.broadcast(self.centroids), self.metric == "cosine", self.metric

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) if cos else x
            d = matrix_distance("l2" if metric != "inner_product" else metric, x, c.value)
            return pd.Series(list(np.argsort(d, axis=1)[:, :probes].astype(np.int32)))

        routed = queries.where(F.col("vector").isNotNull()).select("qid", "vector", near("vector").alias("cells"))
        asked = dict(routed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect())
        held = dict(live.groupBy("cell").count().collect())
        cores = self.spark.sparkContext.defaultParallelism // len(self.centroids)
        layout = [(int(z), *_blocks(asked[z], held[z], k, cores)) for z in sorted(asked.keys() & held.keys())]
        (q, qkind), (v, vkind) = _packed(routed, "qid", "vector", "q", "cells"), _packed(live, "id", "vector", "i", "cell")
        found = _search(q.select("q", "v", F.explode("cells").alias("cell")), v, k, metric, (qkind, vkind), layout)
        return found.select(F.col("q").alias("qid"), F.col("i").alias("id"), "distance", "rank")

    def compact(self) -> None:
        live = self.rows().withColumn("id", F.col("id"))
        from loomkg.common import written

        kept = written(live, name="compact")
        for part in ("vectors", "deleted"):
            drop_path(self.spark, f"{self.path}/{part}")
        self.insert(kept)

    def drop(self) -> None:
        drop_path(self.spark, self.path)
