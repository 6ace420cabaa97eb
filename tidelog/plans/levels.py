"""The level policy over run metadata (level, run_id, key_min, key_max, key_num, bytes): a row for each file."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import Options


def run_metadata(log: DataFrame, *by: str) -> DataFrame:
    """Per run: key range, distinct keys, versions."""
    return log.groupBy(*by).agg(F.min("k").alias("key_min"), F.max("k").alias("key_max"), F.countDistinct("k").alias("key_num"), F.count("*").alias("n_versions"))


def prune(manifest: DataFrame, lo: str, hi: str) -> DataFrame:
    """Runs whose key range meets [lo, hi]."""
    return manifest.where((F.col("key_min") <= hi) & (F.col("key_max") >= lo))


def prune_files(files: list[dict], lo: str | None = None, hi: str | None = None) -> list[dict]:
    """The same for the manifest a store holds: the files that may hold keys from `lo` to `hi`, by bytes; None: no bound."""
    below = None if hi is None else hi.encode()
    above = None if lo is None else lo.encode()
    with_keys = [f for f in files if f["key_min"] is not None]
    return [f for f in with_keys if (below is None or f["key_min"].encode() <= below) and (above is None or f["key_max"].encode() >= above)]


def apart(files: list[dict], epoch: int) -> set[str]:
    """Runs that alone decide on their keys at an epoch: one version for each key, all visible, no other file in their key range."""
    order = sorted((f for f in files if f["key_min"] is not None), key=lambda f: f["key_min"].encode())
    reach, alone = b"", set()
    for i, f in enumerate(order):
        lo, hi = f["key_min"].encode(), f["key_max"].encode()
        free = (i == 0 or reach < lo) and (i + 1 == len(order) or hi < order[i + 1]["key_min"].encode())
        if free and f["n_versions"] == f["key_num"] and f["max_epoch"] <= epoch:
            alone.add(f["run_id"])
        reach = max(reach, hi)
    return alone


def due(files: list[dict], options: Options = Options()) -> list[int]:
    """The levels that are too full, from the top: as `full_levels`, but level 0 only beyond the files it may hold."""
    counts = {level: sum(f["level"] == level for f in files) for level in range(options.max_level - 1)}
    return [level for level, n in counts.items() if n > (options.zero_level_files if level == 0 else options.level_ratio ** (level - 1) * 4)]


def overlap(manifest: DataFrame) -> DataFrame:
    """Each run with `no_overlap_in_next_level`.

    Runs of a level from 1 on do not overlap, so of the next level only the last run that begins before this one ends can
    meet it: a merge in key order finds it, without comparing all pairs of files.
    """
    starts = manifest.select((F.col("level") - 1).alias("l"), F.col("key_min").alias("at"), F.lit(0).alias("kind"), F.col("key_max").alias("end"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("key_min"))
    asks = manifest.select(F.col("level").alias("l"), F.col("key_max").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("end"), F.col("run_id").cast("string").alias("run_id"), "key_min")
    last = F.last("end", ignorenulls=True).over(Window.partitionBy("l").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    merged = starts.unionByName(asks).withColumn("reach", last).where("kind = 1")
    return merged.select(F.col("l").alias("level"), "run_id", (F.coalesce("reach", F.lit("")) < F.col("key_min")).alias("no_overlap_in_next_level"))


def full_levels(manifest: DataFrame, options: Options = Options()) -> DataFrame:
    """Levels with more files than ratio ** (level - 1) * 4; level 0 whenever it has any, the last one never."""
    most = F.when(F.col("level") == 0, 0).otherwise(F.pow(F.lit(options.level_ratio), F.col("level") - 1) * 4)
    return manifest.groupBy("level").agg(F.count("*").alias("files")).where((F.col("level") < options.max_level - 1) & (F.col("files") > most)).select("level")


def pick(manifest: DataFrame, level: int, options: Options = Options()) -> DataFrame:
    """Inputs of the compaction of a level: (role, level, run_id). Level 0 gives all its runs. A deeper level that is too full
    gives one, a run without overlap below if there is one, else the one with the smallest key. Runs of the next level that
    meet the key range of the inputs join in."""
    due = full_levels(manifest, options).where(F.col("level") == level)
    own = manifest.where(F.col("level") == level).join(due, "level", "left_semi")
    if level:
        free = overlap(manifest).where(F.col("level") == level)
        ranked = own.join(free, ["level", "run_id"]).orderBy(F.desc("no_overlap_in_next_level"), "key_min", "run_id")
        own = ranked.limit(1).select(*manifest.columns)
    reach = own.agg(F.min("key_min").alias("lo"), F.max("key_max").alias("hi"))  # one row
    below = manifest.where(F.col("level") == level + 1).join(F.broadcast(reach), (F.col("key_min") <= F.col("hi")) & (F.col("key_max") >= F.col("lo")))
    return own.select(F.lit("source").alias("role"), "level", "run_id").unionByName(below.select(F.lit("target").alias("role"), "level", "run_id"))


def level_sizes(manifest: DataFrame, options: Options = Options()) -> DataFrame:
    """Files, rows and bytes by level, and whether writers must wait (more files in level 0 than allowed)."""
    return manifest.groupBy("level").agg(F.count("*").alias("files"), F.sum("key_num").alias("n_keys"), F.sum("bytes").alias("bytes")).withColumn("stalled", (F.col("level") == 0) & (F.col("files") > options.zero_level_files))


def bloom_size(keys: Column, false_positive: float = Options.false_positive) -> dict[str, Column]:
    """Bits, bytes, bits for each key and hash functions of a run's Bloom filter."""
    bits = F.floor(-F.log(F.lit(false_positive)) * keys / math.log(2) ** 2).cast("long")
    bytes_ = F.floor((bits + 7) / 8).cast("long")
    per_key = F.floor(bytes_ * 8 / keys).cast("long")
    return {"bits": bits, "bytes": bytes_, "bits_per_key": per_key, "hashes": F.least(F.lit(32), F.greatest(F.lit(1), F.floor(per_key * 0.693))).cast("int")}
