"""The mutation log and its snapshots.

A log row is (k, c1..cN, epoch, seq, deleted): an upsert or, with `deleted`, a tombstone. Nothing is ever changed in place.
The state at a read epoch is the newest visible row of each key, without tombstones. Every read is a function of the state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest key in bytes; longer ones are refused, never cut.
KEY_SIZE = 16
SYSTEM = ("epoch", "seq", "deleted")


@dataclass(frozen=True)
class Options:
    """Fixed defaults of the storage layout."""

    rows_per_run: int = 3_354_624
    block_bytes: int = 65_536
    false_positive: float = 0.01
    max_level: int = 5
    level_ratio: int = 10
    zero_level_files: int = 2
    max_memtables: int = 2
    batch_rows: int = 2_048
    #: Mutations after which the memtable is flushed, and write calls after which it is full however few they hold.
    memtable_rows: int = 3_354_624
    slices_per_memtable: int = 32
    #: Whether ending a writer starts what is due.
    maintain: bool = True


def log_schema(columns: list[str]) -> T.StructType:
    values = [T.StructField(c, T.StringType()) for c in columns]
    return T.StructType([T.StructField("k", T.StringType(), False), *values, T.StructField("epoch", T.LongType(), False), T.StructField("seq", T.LongType(), False), T.StructField("deleted", T.BooleanType(), False)])


def log_of(df: DataFrame, k: Column, values: dict[str, Column], epoch: Column, deleted: Column | None = None, seq: Column | None = None) -> DataFrame:
    """A log from any table: key and values become strings, one mutation for each row."""
    return df.select(
        k.cast("string").alias("k"),
        *[v.cast("string").alias(c) for c, v in values.items()],
        epoch.cast("long").alias("epoch"),
        (F.lit(0) if seq is None else seq).cast("long").alias("seq"),
        (F.lit(False) if deleted is None else deleted).alias("deleted"),
    )


def checked(log: DataFrame) -> DataFrame:
    """Refuse keys that are null, too long or hold NUL when the rows are read."""
    fits = F.col("k").isNotNull() & (F.octet_length("k") <= KEY_SIZE) & (F.instr("k", "\0") == 0)
    return log.withColumn("k", F.when(fits, F.col("k")).otherwise(F.raise_error(F.concat(F.lit("bad key: "), F.coalesce("k", F.lit("null"))))))


def value_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c != "k" and c not in SYSTEM]


def newest(log: DataFrame) -> DataFrame:
    """The newest row of each key, tombstones included. Grouped aggregation is combined before the shuffle, so a key with a
    third of all versions costs each task one row."""
    rest = [c for c in log.columns if c != "k"]
    return log.groupBy("k").agg(F.max_by(F.struct(*rest), F.struct("epoch", "seq")).alias("v")).select("k", "v.*")


def visible(log: DataFrame, read_epoch: int | Column | None = None) -> DataFrame:
    return log if read_epoch is None else log.where(F.col("epoch") <= read_epoch)


def state(log: DataFrame, read_epoch: int | Column | None = None) -> DataFrame:
    """(k, values): what a reader at `read_epoch` sees. Filters on values belong above this, filters on keys may go below."""
    return newest(visible(log, read_epoch)).where(~F.col("deleted")).select("k", *value_columns(log))


def read_epoch(active: DataFrame, latest: Column) -> DataFrame:
    """One row: the epoch before the oldest open writer, or the latest one if none is open."""
    return active.agg(F.coalesce(F.min("epoch") - 1, latest).alias("read_epoch"))
