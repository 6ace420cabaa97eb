"""Positions in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.scratch import Scratch


def with_rank(df: DataFrame, key: str, name: str, pieces: int | None = None) -> DataFrame:
    """Add the position (from 0) of each row in the order of a key; keys should be distinct. A null key comes last.

    Rows are dealt out by ranges of the key (`pieces`, else as many as the session's shuffle partitions), sorted inside each, and written once
    with their range and their place in it: the input is not evaluated again, and a lost task can not move a row to another
    range. A range's start is a row (a number for each shuffle partition), sent to all tasks.
    """
    order = F.col(key).asc_nulls_last()
    dealt = df.repartitionByRange(pieces, order) if pieces else df.repartitionByRange(order)
    ranged = dealt.sortWithinPartitions(order)
    numbered = ranged.withColumn("__piece", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    written = Scratch(df.sparkSession).settle(numbered)
    counts = written.groupBy("__piece").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return written.join(F.broadcast(starts), "__piece").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__piece", "__start", "__at")
