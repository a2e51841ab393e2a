"""Reading session logs: one JSON event a line, and which files are new or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "uuid string, parentUuid string, sessionId string, type string, isMeta boolean, timestamp timestamp, promptId string, message struct<model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"


def files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, mtime, size) of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new, or whose time or size differ."""
    return found.join(known, [found.path == known.path, found.mtime == known.mtime, found["size"] == known["size"]], "left_anti")


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events with their file; a line that is no JSON is a row with only `broken` set."""
    # from_json rather than the JSON reader, which refuses queries of the broken lines alone
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    return lines.where(F.trim("value") != "").select(F.from_json("value", EVENT + ", broken string", options).alias("e"), "source_file").select("e.*", "source_file")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
