"""Shared helpers: table access, shared scratch tables, and small numeric tools."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.scratch import Scratch as Scratch  # for the operators

ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So many bytes of rows go to a Python worker at once, where the session sets no bound of its own.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session that bounds batches for Python workers by bytes: ten thousand long texts are more than a task can hold."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if name not in conf.getAll:
        conf.set(name, str(BATCH_BYTES))
    return df


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for an operator's own columns that no column of its input has, in upper or lower case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        n = 0
        while (found := f"__{name}{n or ''}") in used:
            n += 1
        used.add(found)
        out.append(found)
    return out


_kept: dict[object, object] = {}


def keep(name: object, make: Callable[[], object] | None = None) -> object:
    """What `make` gives, made once for all tasks of a Python worker that follow each other with the same `name`.

    A worker runs tasks of many stages: whatever an earlier one kept goes, and its memory is handed back.
    """
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = make() if make else None
    return _kept[name]


def trim() -> None:
    """Hand freed memory of Arrow and of the C library back to the system; workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Memo(dict):
    """A memo of a pure function from strings to bytes, bounded in bytes: when half of `most` is held, what was not asked for
    since the last time goes. So memory is fixed, and results are not affected."""

    #: What an entry takes beside its characters and bytes: both objects' heads and its place in the dictionary.
    ENTRY = 200

    def __init__(self, fn, most: int = 176 << 20):
        super().__init__()
        self.fn, self.most, self.old, self.held = fn, most // 2, {}, 0

    def __missing__(self, key):
        if self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        self.held += self.ENTRY + len(key) + len(value)
        return value
