"""Sharding by histogram sort: splitters refined on exact byte counts, then one exchange.

A first pass writes (key, bytes) of every row; all later counting reads that narrow table. Each round
counts, in every partition, the exact bytes below all candidate boundaries; for every splitter the two
nearest candidates bracket its target, and new candidates are drawn from the keys within the bracket.
Rounds end when every splitter is within `tolerance` of a shard of its target or its bracket holds one key
only. Then rows move once, each to the shard of its key, and are sorted there.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkg.common import ship, written

PROBES = 8


def _ordered_bits(x: pa.Array) -> pa.Array:
    """Numbers that sort as doubles do: -0.0 as 0.0, every NaN above infinity."""
    v = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    v[np.isnan(v)] = np.nan
    bits = v.view(np.int64)
    bits = np.where(np.isnan(v), np.int64(0x7FF8000000000000), bits)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits), mask=np.asarray(x.is_null()))


def order_key(df: DataFrame, cols: list[str]) -> Column:
    """Binary key that sorts as the columns do, nulls first.

    Whole numbers, dates and times are big-endian with the sign bit turned, doubles by their ordered bits, decimals
    digit by digit (complemented below zero), texts as UTF-8 closed by 0 with any 0 inside escaped. Other types
    have no order here and are an error.
    """
    parts = []
    for name in cols:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
            # 0, then a byte above all that may follow the closing 0 of a shorter text
            v = F.concat(F.encode(F.replace(c.cast("string"), F.lit("\0"), F.lit("\0\u00ff")), "utf-8"), F.unhex(F.lit("00")))
        elif isinstance(kind, T.DecimalType):
            digits = F.lpad(F.translate(F.format_number(F.abs(c), kind.scale), ",", ""), kind.precision + 2, "0")
            v = F.encode(F.when(c < 0, F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits)), "utf-8")
        else:
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                n = F.arrow_udf(_ordered_bits, "bigint")(c.cast("double"))
            elif isinstance(kind, T.DateType):
                n = F.unix_date(c).cast("bigint")
            elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                n = F.unix_micros(c.cast("timestamp"))
            elif isinstance(kind, (T.IntegralType, T.BooleanType)):
                n = c.cast("bigint")
            else:
                raise TypeError(f"{name}: {kind.simpleString()} has no order key")
            v = F.unhex(F.lpad(F.hex(n.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
        parts.append(F.when(c.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), v)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _locate(keys: list, bounds: list[bytes]) -> np.ndarray:
    """Number of bounds at or below each key: shard i holds bounds[i - 1] <= key < bounds[i]."""
    return np.fromiter((bisect.bisect_right(bounds, k) for k in keys), np.int32, len(keys))


def _histogram(sizes: DataFrame, bounds: list[bytes], wanted: list[bool]) -> tuple[list[int], list[list[bytes]]]:
    """(bytes, sample of keys) of each interval between the bounds; only wanted intervals are sampled.

    Partitions send one row per interval; the sample keeps the keys of the least hashes, so it doesn't depend
    on the partitioning.
    """
    sc = sizes.sparkSession.sparkContext
    known = sc.broadcast((bounds, wanted))

    def count(batches):  # noqa: ANN001, ANN202
        b, want = known.value
        total = np.zeros(len(b) + 1, np.int64)
        best: list[list[tuple[int, bytes]]] = [[] for _ in total]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            at = _locate(keys, b)
            np.add.at(total, at, batch.column(1).to_numpy())
            h = batch.column(2).to_numpy()
            order = np.lexsort((h, at))
            starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0]) if len(at) else []
            for i, j in zip(starts, [*starts[1:], len(at)], strict=True):
                k = int(at[order[i]])
                if want[k]:
                    more = [(int(h[x]), keys[x]) for x in order[i : min(j, i + 4 * PROBES)]]
                    best[k] = sorted(set(best[k] + more))[:PROBES]
        rows = [i for i in range(len(total)) if total[i]]
        yield pa.record_batch([pa.array(rows, pa.int32()), pa.array(total[rows]), pa.array([[{"h": h, "k": k} for h, k in best[i]] for i in rows], pa.list_(pa.struct([("h", pa.int64()), ("k", pa.binary())])))], ["i", "n", "s"])

    parts = arrow_map_raw(sizes, count, "i int, n bigint, s array<struct<h:bigint,k:binary>>")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), 1, PROBES).alias("s")).collect()
    n, samples = [0] * (len(bounds) + 1), [[] for _ in range(len(bounds) + 1)]
    for r in rows:
        n[r.i], samples[r.i] = r.n, [bytes(x.k) for x in r.s]
    return n, samples


def arrow_map_raw(df: DataFrame, f, schema: str) -> DataFrame:  # noqa: ANN001
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def splitters(sizes: DataFrame, shards: int, tolerance: float, rounds: int = 40) -> tuple[list[bytes], list[int]]:
    """(boundaries, bytes of each shard); sizes: (key, bytes, hash of the key). An error if `rounds` do not suffice."""
    bounds: list[bytes] = []
    n, samples = _histogram(sizes, bounds, [True])
    total = sum(n)
    targets = [total * (i + 1) // shards for i in range(shards - 1)]
    slack = tolerance * total / shards
    stuck: set[tuple[bytes | None, bytes | None]] = set()
    for _ in range(rounds):
        below = np.cumsum(n)[:-1] if bounds else np.zeros(0, np.int64)
        wanted: set[int] = set()
        for t in targets:
            i = int(np.searchsorted(below, t))
            near = min([abs(int(below[j]) - t) for j in (i - 1, i) if 0 <= j < len(below)], default=total)
            if near > slack:
                wanted.add(i)
        more: set[bytes] = set()
        for i in wanted:
            lo = bounds[i - 1] if i else None
            fresh = {k for k in samples[i] if k != lo}
            # a sample of one key that is the lower bound: nothing lies between
            if not fresh:
                stuck.add((lo, bounds[i] if i < len(bounds) else None))
            more |= fresh
        if not more:
            break
        bounds = sorted({*bounds, *more})
        edges = [None, *bounds, None]
        below_wanted = [True] * (len(bounds) + 1)
        for i in range(len(bounds) + 1):
            below_wanted[i] = (edges[i], edges[i + 1]) not in stuck
        n, samples = _histogram(sizes, bounds, below_wanted)
    else:
        raise RuntimeError(f"boundaries still move after {rounds} rounds")
    below = np.cumsum(n)[:-1] if bounds else np.zeros(0, np.int64)
    out = sorted({bounds[min((j for j in (int(np.searchsorted(below, t)) - 1, int(np.searchsorted(below, t))) if 0 <= j < len(below)), key=lambda j: abs(int(below[j]) - t))] for t in targets if len(below)})
    at = [bounds.index(b) for b in out]
    cuts = [0, *[int(below[i]) for i in at], total]
    return out, [b - a for a, b in zip(cuts, cuts[1:], strict=False)]


def shard(docs: DataFrame, keys: list[str], text_col: str = "text", shard_bytes: int = 64 << 20, tolerance: float = 0.05, shard_col: str = "shard") -> DataFrame:
    """The rows in shards of about `shard_bytes` bytes of text, sorted by `keys` within and across shards.

    Each shard is one partition. Rows with equal keys share a shard, so a shard may exceed the tolerance by the
    bytes of one key; null and empty texts count no bytes, null keys sort first, rows with tied keys and repeated
    rows stay together in any order, and a very long text is one row of its shard. A column already named as the
    shard column is replaced, others pass whatever their names; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    key = order_key(docs, keys)
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("bigint")
    sizes = written(docs.select(key.alias("k"), size.alias("n")).select("k", "n", F.xxhash64("k").alias("h")), name="sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, round(total / shard_bytes))
    bounds, _ = splitters(sizes, shards, tolerance) if shards > 1 else ([], [])
    known = docs.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(_locate(k.tolist(), known.value))

    rows = docs.drop(shard_col) if shard_col in docs.columns else docs
    rows = rows.withColumn("__key", key).withColumn(shard_col, place("__key"))
    return rows.repartitionById(len(bounds) + 1, F.col(shard_col)).sortWithinPartitions("__key").drop("__key")

