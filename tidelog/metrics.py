"""Operator metrics: samples in, a summary by operator out."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def summary(samples: DataFrame, op: Column, latency: Column, share: float = 0.99) -> DataFrame:
    """(op, n, total, p99): p99 is the sample at place floor(share * n) of the sorted ones, counted from 0.

    Only the sum and the count need all rows of an operator at once. The place is found by counting how often each value
    occurs, so an operator with most of the samples is spread over its values.
    """
    rows = samples.select(op.alias("op"), latency.alias("v"))
    values = rows.groupBy("op", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("op").orderBy("v"))
    totals = values.groupBy("op").agg(F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")), 2).alias("total"))
    placed = values.withColumn("upto", upto).join(totals, "op").where(F.col("upto") > F.floor(F.col("n") * share))
    return placed.groupBy("op", "n", "total").agg(F.min("v").alias("p99"))


class Profiler:
    """Wall-clock samples of named actions on the driver, with the bytes of the files they opened and wrote."""

    def __init__(self) -> None:
        self.samples: list[tuple[str, float, int, int]] = []

    @contextmanager
    def timed(self, op: str) -> Iterator[dict]:
        """Time an action, not the building of a DataFrame; `read` and `written` of what is yielded are its bytes."""
        began, sample = time.perf_counter(), {}
        try:
            yield sample
        finally:
            self.samples.append((op, time.perf_counter() - began, int(sample.get("read") or 0), int(sample.get("written") or 0)))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.samples, "op string, seconds double, bytes_read long, bytes_written long")

    def summary(self, spark: SparkSession) -> DataFrame:
        return summary(self.rows(spark), F.col("op"), F.col("seconds"))

    def bytes(self, spark: SparkSession) -> DataFrame:
        """(op, bytes_read, bytes_written) in all."""
        return self.rows(spark).groupBy("op").agg(F.sum("bytes_read").alias("bytes_read"), F.sum("bytes_written").alias("bytes_written"))
