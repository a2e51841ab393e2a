"""Queries of this subpackage, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomkg.common import table
from loomkg.llm import decontaminate, fertility, histogram_sort, license_scan, line_dedup, ordinal_quality, packing, simhash_pigeonring, suffix_dedup, toxicity


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_quality.score(docs, ordinal_quality.train(docs, ordinal_quality.ratings_of(table(spark, sf_dir, "labels"))))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard(table(spark, sf_dir, "documents"), ["lang", "source", "doc_id"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pigeonring.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), length_col="n_chars")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_ordinal, op2_tokeniser_fertility, op3_histogram_sort, op4_suffix_dedup, op5_toxicity, op6_simhash_near_dedup, op7_line_dedup, op8_license_scan, op9_packing, op10_decontamination)
}
ORACLES = {"op7_line_dedup": line_dedup.ORACLE, "op8_license_scan": license_scan.oracle(), "op9_packing": packing.ORACLE}
