"""Line dedup over levelled sorted runs of line hashes (a log-structured merge of seen lines).

Every batch reduces its lines to the first place of each 128-bit hash, anti-joins that with all runs
and writes what is new as a run of level 0. A level that holds `fanout` runs is compacted into one run
of the next. Runs are bucketed by hash and sorted within buckets, so the anti-joins merge them without
another exchange: only the batch moves.

Defined results: a line's first place is the least (id, hash of the text, line number), nulls first,
whatever the number of batches. Lines are compared trimmed of spaces; blank lines stay. A document all of
whose other lines are repeats is dropped; one that was blank or null from the start stays as it is.
Rows equal in id and text are one document and share its result. Other columns pass through untouched.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkg.common import new_path, shuffle_partitions

_KEY = ["__h1", "__h2"]
_AT = ["__k", "__t", "__n"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _first_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, text hash, line number) of the first place of each line of these documents."""
    text = F.col(f"`{text_col}`").cast("string")
    at = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").alias("__k"), F.xxhash64(text).alias("__t"), F.posexplode(_lines(text)).alias("__n", "__line"))
    line = F.trim("__line")
    rows = at.where(line != "").select(F.xxhash64(line).alias("__h1"), F.xxhash64(line, F.lit(1)).alias("__h2"), *_AT)
    # equal (id, text) rows repeat a place: the minimum keeps one
    first = rows.groupBy(*_KEY).agg(F.min(F.struct(*_AT)).alias("m"))
    return first.select(*_KEY, *[F.col(f"m.{c}").alias(c) for c in _AT])


@dataclass
class Run:
    table: str
    path: str
    level: int


@dataclass
class LineRuns:
    """The seen lines: runs by level."""

    spark: SparkSession
    buckets: int = 0
    fanout: int = 3
    runs: list[Run] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or shuffle_partitions(self.spark)

    def _write(self, df: DataFrame, level: int) -> Run:
        run = Run(f"loomkg_lines_{uuid.uuid4().hex}", new_path(self.spark, "lines"), level)
        df.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", run.path).format("parquet").saveAsTable(run.table)
        return run

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Merge-anti-join a batch with the runs and add what is new as a run."""
        new = _first_lines(docs, id_col, text_col)
        for run in self.runs:
            new = new.hint("merge").join(self.spark.table(run.table).select(*_KEY), _KEY, "left_anti")
        self.runs.append(self._write(new, 0))
        self.compact()

    def compact(self) -> None:
        level = 0
        while any(r.level >= level for r in self.runs):
            full = [r for r in self.runs if r.level == level]
            if len(full) >= self.fanout:
                rows = self.spark.table(full[0].table)
                for r in full[1:]:
                    rows = rows.unionByName(self.spark.table(r.table))
                merged = self._write(rows, level + 1)
                for r in full:
                    self.runs.remove(r)
                    self.drop(r)
                self.runs.append(merged)
            level += 1

    def drop(self, run: Run) -> None:
        from loomkg.common import drop_path

        self.spark.sql(f"drop table if exists {run.table}")
        drop_path(self.spark, run.path)

    def kept(self) -> DataFrame | None:
        """(id, text hash, line number) of all first places; the runs are read by path, not by catalog."""
        parts = [self.spark.read.schema(self.spark.table(r.table).schema).parquet(r.path).select(*_AT) for r in self.runs]
        for r in self.runs:
            self.spark.sql(f"drop table if exists {r.table}")
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out


def _batches(docs: DataFrame, id_col: str, batches: int) -> list[DataFrame]:
    """Ascending ranges of the id, of about equal row counts; nulls are in the first."""
    if batches <= 1:
        return [docs]
    k, kind = F.col(f"`{id_col}`"), docs.schema[id_col].dataType
    if isinstance(kind, T.BooleanType):
        k = k.cast("int")
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        # seven bytes behind the prefix that all ids share, as a number: it rises with the id
        raw = k.cast("binary")
        ends = docs.agg(F.min(raw).alias("a"), F.max(raw).alias("b")).first()
        shared = os.path.commonprefix([bytes(ends.a or b""), bytes(ends.b or b"")])
        k = F.conv(F.rpad(F.hex(F.substring(raw, len(shared) + 1, 7)), 14, "0"), 16, 10).cast("bigint")
    cuts = docs.agg(F.percentile_approx(k, [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [docs]
    out = [docs.where(k.isNull() | (k < cuts[0]))]
    out += [docs.where((k >= a) & (k < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [*out, docs.where(k >= cuts[-1])]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 3, length_col: str | None = None) -> DataFrame:
    """The documents with the first place of each line only; `length_col` is set to the new length.

    The first place is that of the least id (a null id comes first), then of the first line; of tied ids with
    different texts it is the text of the least hash. Blank lines stay. Null, empty and blank texts stay as they
    are; a document left without lines goes; rows that repeat id and text share their fate; very long texts are
    read whole; other columns pass untouched, whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout=fanout)
    for batch in _batches(docs, id_col, batches):
        runs.add(batch.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t")), "k", "t")
    kept = runs.kept().groupBy("__k", "__t").agg(F.collect_list("__n").alias("__kept"))
    text = F.col(f"__d.`{text_col}`").cast("string")
    joined = docs.alias("__d").join(kept.alias("__r"), F.col(f"__d.`{id_col}`").eqNullSafe(F.col("__r.__k")) & (F.xxhash64(text) == F.col("__r.__t")), "left")
    # split once: a lambda over an expression would split for every line
    joined = joined.withColumn("__lines", _lines(text)).withColumn("__kept", F.col("__r.__kept"))
    lines = F.col("__lines")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    blank = F.filter(every, lambda i: F.trim(F.get(lines, i)) == "")
    joined = joined.withColumn("__blank", blank)
    blank = F.col("__blank")
    stay = F.array_intersect(every, F.array_union(F.coalesce(F.col("__kept"), F.array().cast("array<int>")), blank))
    joined = joined.withColumn("__stay", stay)
    stay = F.col("__stay")
    clean = F.when(F.size(stay) == F.size(lines), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    # on the text itself, so that this filter does not pull the split back into a lambda
    was_blank = F.trim(F.translate(text, "\n", "")) == ""
    alive = joined.where(text.isNull() | was_blank | F.col("__kept").isNotNull())
    cols = {c: F.col(f"__d.`{c}`") for c in docs.columns} | {text_col: clean}
    if length_col in docs.columns:
        cols[length_col] = F.length(clean).cast(docs.schema[length_col].dataType)
    return alive.select(*[v.alias(c) for c, v in cols.items()])


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
r AS (SELECT *, trim(line, ' ') = '' AS blank, row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, n) AS place FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) FILTER (blank OR place = 1) AS text,
  bool_and(blank) OR bool_or(NOT blank AND place = 1) AS alive FROM r GROUP BY doc_id)
SELECT d.doc_id, k.text, d.lang, d.source, length(k.text)::BIGINT AS n_chars FROM documents d JOIN k USING (doc_id) WHERE alive
"""
