"""Edge tables: canonical form, direction, time windows, node index, and the in-memory form of a small graph."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import ship, written

#: Arcs up to which a graph is worked on by one task or sent to all; beyond it operators stay distributed.
LOCAL_ARCS = 2_000_000
DIRECTIONS = ("forward", "reverse", "both")


def valid_identifier(name: str | None) -> bool:
    """Non-empty ASCII letters, digits and underscores; a leading digit is fine."""
    return bool(name) and re.fullmatch(r"[A-Za-z0-9_]+", name) is not None


def check_identifier(name: str, what: str = "identifier") -> str:
    if not valid_identifier(name):
        raise ValueError(f"invalid {what}: {name!r}")
    return name


def check_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    return direction


def canonical(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, timestamp: str | None = None, start=None, end=None, seq: str | None = None) -> DataFrame:  # noqa: ANN001
    """(src, dst, weight[, edge_seq]): text ids, rows with a null end left out, inclusive time bounds pushed to the scan."""
    for c in (src, dst, weight, timestamp, seq):
        if c is not None:
            check_identifier(c, "column name")
            if c not in df.columns:
                raise ValueError(f"no such column: {c}")
    if timestamp is not None:
        if start is not None:
            df = df.where(F.col(timestamp) >= F.lit(start))
        if end is not None:
            df = df.where(F.col(timestamp) <= F.lit(end))
    w = F.coalesce(F.expr(f"try_cast(`{weight}` AS double)"), F.lit(0.0)) if weight else F.lit(1.0)
    cols = [F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), w.alias("weight")]
    if seq:
        cols.append(F.col(seq).cast("bigint").alias("edge_seq"))
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*cols)


def arcs(edges: DataFrame, direction: str = "forward") -> DataFrame:
    """(src, dst, weight) in the direction of travel."""
    check_direction(direction)
    fwd = edges.select("src", "dst", "weight")
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return fwd if direction == "forward" else rev if direction == "reverse" else fwd.unionAll(rev)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Rows with a dense 0-based index in the given order: a range sort, counts of its partitions, offsets."""
    spark = df.sparkSession
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name="index")
    part = F.shiftright("__at", 33)
    counts = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for p, n in counts:
        offsets.append((p, at))
        at += n
    if not offsets:
        return placed.drop("__at").withColumn(name, F.lit(None).cast("bigint"))
    off = spark.createDataFrame(offsets, "__p bigint, __off bigint")
    return placed.withColumn("__p", part).join(F.broadcast(off), "__p").withColumn(name, F.col("__off") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__p", "__off", "__at")


def node_index(edges: DataFrame) -> DataFrame:
    """(node, idx): order of first appearance where edges carry edge_seq, else order of the ids."""
    if "edge_seq" not in edges.columns:
        return dense_index(nodes(edges), ["node"])
    seen = edges.select(F.col("src").alias("node"), (F.col("edge_seq") * 2).alias("at")).union(edges.select("dst", F.col("edge_seq") * 2 + 1))
    return dense_index(seen.groupBy("node").agg(F.min("at").alias("at")), ["at"]).select("node", "idx")


@dataclass
class Graph:
    """A small graph in memory: names by index, arcs in scan order."""

    names: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(pdf: pd.DataFrame) -> Graph:
        """Scan order is edge_seq with node indices of first appearance, else (src, dst) with indices of sorted names."""
        if "edge_seq" in pdf.columns:
            pdf = pdf.sort_values("edge_seq", kind="stable")
            codes, names = pd.factorize(np.stack([pdf["src"].to_numpy(object), pdf["dst"].to_numpy(object)], axis=1).ravel())
            s, d = codes[0::2], codes[1::2]
            return Graph(np.asarray(names, object), s.astype(np.int64), d.astype(np.int64), pdf["weight"].to_numpy(float))
        both = pd.concat([pdf["src"], pdf["dst"]], ignore_index=True)
        codes, names = pd.factorize(both, sort=True)
        n = len(pdf)
        s, d, w = codes[:n].astype(np.int64), codes[n:].astype(np.int64), pdf["weight"].to_numpy(float)
        o = np.lexsort((w, d, s))
        return Graph(np.asarray(names, object), s[o], d[o], w[o])

    @staticmethod
    def of_table(table: pa.Table) -> Graph:
        """The same from an Arrow table, with one Python string for each node instead of two for each arc."""
        ends = [c.cast(pa.string()) for c in (table.column("src"), table.column("dst"))]
        if any(c.null_count for c in ends):
            return Graph.of(table.to_pandas())
        both = pa.chunked_array([*ends[0].chunks, *ends[1].chunks], pa.string()).dictionary_encode().combine_chunks()
        both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
        names, codes, n = np.array([*both.dictionary.to_pylist(), None], object)[:-1], both.indices.to_numpy(), len(table)
        s, d, w = codes[:n].astype(np.int64), codes[n:].astype(np.int64), table.column("weight").to_numpy().astype(float)
        if "edge_seq" in table.column_names:
            o = np.argsort(table.column("edge_seq").to_numpy(), kind="stable")
            at, seen = pd.factorize(np.stack([s[o], d[o]], axis=1).ravel())
            return Graph(names[seen], at[0::2].astype(np.int64), at[1::2].astype(np.int64), w[o])
        order = np.argsort(names, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        s, d = place[s], place[d]
        o = np.lexsort((w, d, s))
        return Graph(names[order], s[o], d[o], w[o])

    @property
    def n(self) -> int:
        return len(self.names)

    def directed(self, direction: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if direction == "forward":
            return self.src, self.dst, self.weight
        if direction == "reverse":
            return self.dst, self.src, self.weight
        return np.concatenate([self.src, self.dst]), np.concatenate([self.dst, self.src]), np.concatenate([self.weight, self.weight])

    def csr(self, direction: str, distinct: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, targets, weights) with arcs of a node in scan order, forward ones first; distinct='min' merges parallel arcs."""
        s, d, w = self.directed(direction)
        if distinct and len(s):
            o = np.lexsort((w, d, s))
            s, d, w = s[o], d[o], w[o]
            first = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
            s, d, w = s[first], d[first], w[first]
        else:
            o = np.argsort(s, kind="stable")
            s, d, w = s[o], d[o], w[o]
        return np.searchsorted(s, np.arange(self.n + 1)), d, w

    def id_of(self, name: str) -> int:
        hit = np.flatnonzero(self.names == name)
        return int(hit[0]) if len(hit) else -1


def held(edges: DataFrame) -> DataFrame:
    """The edges written once, for operators that read them several times: to count them, to walk them, for each level."""
    cols = [c for c in ("src", "dst", "weight", "edge_seq") if c in edges.columns]
    return written(edges.select(*cols), name="edges")


def is_small(edges: DataFrame, limit: int = LOCAL_ARCS) -> bool:
    """Whether the edges are few enough to hold at once; counting stops at the limit."""
    return edges.select(F.lit(1)).limit(limit + 1).count() <= limit


def in_one_task(edges: DataFrame, f: Callable[[Graph], pd.DataFrame], schema: str) -> DataFrame:
    """Run f on the whole graph inside one task; only for graphs of checked size."""
    ship(edges.sparkSession)
    cols = [c for c in ("src", "dst", "weight", "edge_seq") if c in edges.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [pa.Table.from_pandas(x, preserve_index=False) for x in frames if len(x)]
        if got:
            out = f(Graph.of_table(pa.concat_tables(got)))
            if len(out):
                yield out

    return edges.select(*cols).repartition(1).mapInPandas(run, schema)


def collected(edges: DataFrame) -> Graph:
    """The graph on the driver, to be broadcast; only for graphs of checked size."""
    cols = [c for c in ("src", "dst", "weight", "edge_seq") if c in edges.columns]
    return Graph.of_table(edges.select(*cols).toArrow())
