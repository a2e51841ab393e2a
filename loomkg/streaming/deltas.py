"""Change-driven processing: edge changes merged into the cache, new rows embedded as they come, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomkg.operators.adjacency import AdjacencyCache


def maintain_cache(changes: DataFrame, cache: AdjacencyCache, checkpoint: str) -> StreamingQuery:
    """changes: stream of (src, dst, weight, op, seq). A batch is applied once: its number is kept with the cache."""
    spark = cache.spark
    done = f"{cache.path}/batches"

    def apply(batch: DataFrame, number: int) -> None:
        try:
            if not spark.read.parquet(done).where(F.col("batch") == number).isEmpty():
                return
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        if not batch.isEmpty():
            cache.incremental_rebuild(batch)
        spark.createDataFrame([(number,)], "batch bigint").coalesce(1).write.mode("append").parquet(done)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_new(rows: DataFrame, index, embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """rows: stream of (id, text). New ids are embedded and inserted; ids already there are deleted first."""

    def apply(batch: DataFrame, number: int) -> None:
        fresh = embed(batch.dropDuplicates(["id"]))
        old = [r.id for r in index.rows().join(batch.select("id").distinct(), "id", "left_semi").select("id").toLocalIterator()]
        if old:
            index.delete(old)
        index.insert(fresh)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, end, event_type, n, total) over event time with a watermark; works on streams and tables."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) sessions that end after a gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
