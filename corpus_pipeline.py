"""From raw documents to packed training windows, in five stages; part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomkg.common import new_path, table
from loomkg.llm import decontaminate, line_dedup, packing, simhash_pigeonring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents with a calibrated probability of one half or more go."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: every line stays in its first place only; documents left without lines go."""
    return line_dedup.dedup_lines(docs, length_col="n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash_pigeonring.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages go; documents that are mostly benchmark go whole."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: all remaining tokens in windows of 2,048."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack_windows),
]

#: The trained model of the first stage has no SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
