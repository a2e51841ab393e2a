"""Packing by concatenate-and-cut: two passes of prefix sums, then fixed windows with boundary records.

Tokens are runs of characters other than ASCII white space and NUL; documents are concatenated in storage order (file, then row). The
first pass sums the tokens of every split, the part of a file that one task reads, whatever rows a filter
has left of it; the prefix sums of these totals are the global offsets. The second pass reads the splits
again, cuts them at multiples of the window and emits the windows it holds whole; only the two windows at
the edges of a split cross it as boundary records, and these alone are exchanged to be joined. Text is never
shuffled. Driver and workers hold 24 bytes for each split, of which there is one per
spark.sql.files.maxPartitionBytes of input (and per file): 20 MB for 100 TB in splits of 128 MB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import ship, written
from loomkg.llm import _bytes as B

SCHEMA = "window_id bigint, tokens int, text string, doc_ids array<{kind}>, starts array<int>, lengths array<int>"


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(file, block, split, k, t), split being a hash of file and block; None if the table is no scan of files."""
    try:
        at = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
        at.schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() and e.getCondition().startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "AMBIGUOUS")):
            return None
        raise
    return at.select("file", "block", F.xxhash64("file", "block").alias("split"), "k", "t")


def _stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same of a copy written in the order of ids, for tables that are no longer split as their files are."""
    own = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return _placed(written(own.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t"), name="pack"), "k", "t")


def _stretches(batches, text: int):  # noqa: ANN001, ANN202
    """(split, batch) with batches cut where the split in column 0 changes and at about 4 MB of the text column."""
    for batch in batches:
        for b in B.pieces(batch, text, 1 << 22):
            split = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(cut, cut[1:], strict=False):
                if j > i:
                    yield int(split[i]), b.slice(i, j - i)


def _totals(rows: DataFrame) -> list[tuple[str, int, int, int]]:
    """(file, block, split, tokens) of every stretch of rows of one split, in storage order."""

    def count(batches):  # noqa: ANN001, ANN202
        names = ["file", "block", "split", "n"]
        now: list = []
        for split, b in _stretches(batches, 1):
            buf, offs = B.flat(b.column(1))
            n = len(B.spans(buf, offs, B.TOKENS)[0])
            if now and now[2] == split:
                now[3] += n
            else:
                if now:
                    yield pa.record_batch([[x] for x in now], names)
                now = [b.column(2)[0].as_py(), b.column(3)[0].as_py(), split, n]
        if now:
            yield pa.record_batch([[x] for x in now], names)

    got = rows.select("split", "t", "file", "block").mapInArrow(count, "file string, block bigint, split bigint, n bigint").collect()
    return sorted((r.file, r.block, r.split, r.n) for r in got)


def pack(docs: DataFrame, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(window_id, tokens, text, doc_ids, starts, lengths): whole corpus in windows of `window` tokens, the last may be short.

    doc_ids, starts and lengths are the boundary records: which document's tokens begin where in the window.
    Tokens are joined by one space. Null and empty texts have no tokens and no record; a null id is a null
    in doc_ids; repeated rows are packed each, in their own places, so there are no ties to break; an empty table gives
    no windows; a document longer than a window spans as many as it needs; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _placed(docs, id_col, text_col)
    totals = _totals(rows) if rows is not None else None
    # a split that several tasks hold, as behind a shuffle, has no order of its own
    if totals is None or len({x[2] for x in totals}) < len(totals):
        rows = _stored(docs, id_col, text_col)
        totals = _totals(rows)
    splits = np.array([x[2] for x in totals], np.int64)
    if len(np.unique(splits)) < len(splits):
        raise RuntimeError("two splits share a hash")
    size = np.array([x[3] for x in totals], np.int64)
    order = np.argsort(splits)
    known = docs.sparkSession.sparkContext.broadcast((splits[order], (np.cumsum(size) - size)[order], size[order]))

    def cut(batches):  # noqa: ANN001, ANN202
        names = ["window_id", "tokens", "text", "doc_ids", "starts", "lengths", "whole", "at"]
        id_type = None
        now, pos, end = None, 0, 0
        open_: dict = {}

        def flush() -> dict:
            x = dict(open_)
            open_.clear()
            return x

        def batch_of(out: list[dict]) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([o["w"] for o in out], pa.int64()), pa.array([o["n"] for o in out], pa.int32()), pa.array([" ".join(o["t"]) for o in out], pa.string()), pa.array([o["d"] for o in out], pa.list_(id_type)),
                 pa.array([o["s"] for o in out], pa.list_(pa.int32())), pa.array([o["l"] for o in out], pa.list_(pa.int32())), pa.array([o["n"] == window for o in out]), pa.array([o["at"] for o in out], pa.int64())],
                names=names,
            )

        keys, bases, sizes = known.value
        for split, b in _stretches(batches, 2):
            id_type = b.column(1).type
            out: list[dict] = []
            if split != now:
                if open_:
                    out.append(flush())
                at = int(np.searchsorted(keys, split))
                if pos != end or at == len(keys) or keys[at] != split:
                    raise RuntimeError("the second pass read other rows than the first")
                now, pos = split, int(bases[at])
                end = pos + int(sizes[at])
            buf, offs = B.flat(b.column(2))
            s, e, first = B.spans(buf, offs, B.TOKENS)
            ids = b.column(1).to_pylist()
            for d in range(b.num_rows):
                i, last = int(first[d]), int(first[d + 1])
                if last > i:
                    tokens = bytes(buf[s[i] : e[last - 1]]).decode("utf-8", "replace").translate(_SPACES).split(" ")
                    tokens = [t for t in tokens if t] if len(tokens) != last - i else tokens
                    k = 0
                    while k < len(tokens):
                        w = pos // window
                        if not open_:
                            open_.update(w=w, n=0, t=[], d=[], s=[], l=[], at=pos)
                        take = min(len(tokens) - k, (w + 1) * window - pos)
                        open_["t"].append(" ".join(tokens[k : k + take]))
                        open_["d"].append(ids[d])
                        open_["s"].append(pos - w * window)
                        open_["l"].append(take)
                        open_["n"] += take
                        pos, k = pos + take, k + take
                        if pos % window == 0:
                            out.append(flush())
            if out:
                yield batch_of(out)
        if open_:
            yield batch_of([flush()])
        if pos != end:
            raise RuntimeError("the second pass read other rows than the first")

    parts = written(rows.select("split", "k", "t").mapInArrow(cut, SCHEMA.format(kind=kind) + ", whole boolean, at bigint"), ["whole"], name="windows")
    names = ["window_id", "tokens", "text", "doc_ids", "starts", "lengths"]
    whole = parts.where("whole").select(names)
    edge = parts.where("not whole").groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("at", "tokens", "text", "doc_ids", "starts", "lengths"))).alias("p"))
    joined = edge.select(
        "window_id",
        F.aggregate("p.tokens", F.lit(0), lambda a, x: a + x).alias("tokens"),
        F.array_join("p.text", " ").alias("text"),
        *[F.flatten(f"p.{c}").alias(c) for c in names[3:]],
    )
    return whole.unionByName(joined)


_SPACES = {0: " ", 9: " ", 10: " ", 12: " ", 13: " "}

ORACLE = """
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS token,
  generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> ''), 1) AS i FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM t),
d AS (SELECT g // 2048 AS window_id, doc_id, min(g % 2048) AS s, count(*) AS l FROM p GROUP BY 1, 2),
b AS (SELECT window_id, list(doc_id ORDER BY s) AS doc_ids, list(s::INTEGER ORDER BY s) AS starts, list(l::INTEGER ORDER BY s) AS lengths FROM d GROUP BY 1),
w AS (SELECT g // 2048 AS window_id, count(*)::INTEGER AS tokens, string_agg(token, ' ' ORDER BY g) AS text FROM p GROUP BY 1)
SELECT w.window_id, w.tokens, w.text, b.doc_ids, b.starts, b.lengths FROM w JOIN b USING (window_id)
"""
