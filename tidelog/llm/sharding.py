"""Global shuffle into shards: a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Scratch, free_names, small_batches

#: A bucket's start is two numbers; up to so many buckets (16 MB) they are sent to every task, beyond that they are joined.
SENT = 1_000_000


def _shuffler(seed: int, origin: str, hashed: str, place: str):
    def shuffle(key, rows):
        # Rows come in any order from the exchange: sort by their hash and place of origin, so a lost task is redone alike.
        rows = rows.sort_by([(hashed, "ascending"), (origin, "ascending")])
        bucket = int(key[0].as_py())
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(rows.num_rows)  # Fisher-Yates
        return rows.take(pa.array(order)).drop_columns([hashed, origin]).append_column(place, pa.array(np.arange(rows.num_rows)))

    return shuffle


def external_shuffle(docs: DataFrame, shards: int = 24, seed: int = 11, text: str = "text", bucket_bytes: int = 24 << 20,
                     names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """All rows in a uniformly random global order, dealt out to `shards` shards whose row counts differ by one at most.

    Pass one scatters every row by a seeded hash of its place in the input into as many buckets as are needed for
    `bucket_bytes` of text each; as only the place counts, copies of a row or a key scatter as any rows do. Pass two
    shuffles each bucket in memory (Fisher-Yates, seeded by bucket) and writes it to the shared folder. Buckets follow each
    other in the global order, and each shard is one stretch of it. Texts cross the network once: the buckets' starts are
    two numbers for each, sent to the tasks that read the buckets again (joined by bucket where there are over SENT of them).
    The order depends on the seed and on how the input is split into tasks.

    Nulls, empty texts and repeated rows are rows like any others; an empty table gives an empty result. Columns of the
    names given in `names` are replaced, all others kept, whatever they are called. A single row larger than a bucket is a
    bucket's worth by itself.
    """
    if not 0 < shards:
        raise ValueError("shards must be positive")
    scratch = Scratch(small_batches(docs).sparkSession)
    docs = docs.drop(*names)
    origin, hashed, bucket, place, start, every, at = free_names([*docs.columns, *names], "origin", "hashed", "bucket", "place", "start", "every", "at")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    scattered = (
        docs.withColumn(origin, F.monotonically_increasing_id())
        .withColumn(hashed, F.xxhash64(origin, F.lit(seed)))
        .withColumn(bucket, F.pmod(F.col(hashed), F.lit(buckets)).cast("long"))
    )
    schema = T.StructType([f for f in scattered.schema.fields if f.name not in (origin, hashed)] + [T.StructField(place, T.LongType())])
    written = scratch.settle(scattered.groupBy(bucket).applyInArrow(_shuffler(seed, origin, hashed, place), schema))
    counts = written.groupBy(bucket).agg(F.count("*").alias(every))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(bucket, F.coalesce(F.sum(every).over(before), F.lit(0)).alias(start), F.sum(every).over(Window.partitionBy()).alias(every))
    placed = written.join(F.broadcast(starts) if buckets <= SENT else starts, bucket).withColumn(at, F.col(start) + F.col(place))
    return (
        placed.withColumn(names[0], F.floor(((F.col(at) + 1) * shards - 1) / F.col(every)).cast("int"))
        .withColumn(names[1], F.col(at) - F.expr(f"(`{names[0]}` * `{every}`) div {shards}"))
        .drop(bucket, place, start, every, at)
    )


def write_shards(shuffled: DataFrame, path: str, names: tuple[str, str] = ("shard", "slot")) -> None:
    """One folder for each shard, its rows in slot order within each file."""
    shuffled.sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)
