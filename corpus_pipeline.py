"""From raw documents to packed sequences: five stages, each an operator of tidelog.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, line_dedup, near_dedup, packing, quality
from tidelog.llm.common import Scratch, free_names, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones; it learns from the labels of those at hand."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, good = free_names(docs.columns, "score", "good")
    return quality.score(docs, model, names=(score, good)).where(F.col(good) == 1).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on much of their source go; every document stays."""
    cleaned = line_dedup.line_dedup(docs, counts=None)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_boilerplate), ("near_dedup", drop_copies), ("decontaminate", drop_leaks), ("pack", pack)]

#: The classifier, the sampled candidates and the packing have no form in SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.settle(docs)
    return docs
