"""Bloom filters as tables: a row for each 64-bit word, so a filter of any size is built and probed in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.levels import bloom_size


def _places(key: Column, size: Column, hashes: Column) -> Column:
    """Double hashing: `hashes` bit positions of a key."""
    first, second = F.pmod(F.xxhash64(key), size), F.pmod(F.xxhash64(key, F.lit(1)), size)
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(first + i * second, size))


def build(keys: DataFrame, by: str, false_positive: float = 0.01) -> DataFrame:
    """(by, size, hashes, word, bits) from (by, k): the filter of each run."""
    counts = keys.groupBy(by).agg(F.countDistinct("k").alias("n"))
    sized = bloom_size(F.col("n"), false_positive)
    sizes = counts.select(by, (sized["bytes"] * 8).alias("size"), sized["hashes"].alias("hashes"))
    at = keys.join(sizes, by).select(by, "size", "hashes", F.explode(_places(F.col("k"), F.col("size"), F.col("hashes"))).alias("at"))
    one = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    return at.groupBy(by, "size", "hashes", F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def may_hold(filters: DataFrame, by: str, asked: DataFrame) -> DataFrame:
    """Of the pairs (by, k), those that the run's filter does not rule out."""
    sizes = filters.select(by, "size", "hashes").distinct()
    at = asked.select(by, "k").distinct().join(sizes, by).select(by, "k", "hashes", F.explode(_places(F.col("k"), F.col("size"), F.col("hashes"))).alias("at"))
    at = at.withColumn("word", F.floor(F.col("at") / 64)).withColumn("mask", F.expr("shiftleft(1L, cast(pmod(at, 64) as int))"))
    hit = at.join(filters.select(by, "word", "bits"), [by, "word"]).where("(bits & mask) <> 0")
    return hit.groupBy(by, "k", "hashes").agg(F.count("*").alias("n")).where("n = hashes").select(by, "k")
