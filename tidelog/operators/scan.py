"""Reads of a state: points, key ranges, ordered prefixes and cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ordinals import with_rank


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("k") == key)


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the given keys (k); absent and deleted keys give none."""
    return state.join(keys.select("k").distinct(), "k", "left_semi")


def key_range(state: DataFrame, lo: str, hi: str) -> DataFrame:
    """Keys from lo to hi, both included, in byte order."""
    return state.where(F.col("k").between(lo, hi))


def scan_k(state: DataFrame, k: int, start: str) -> DataFrame:
    """The first k rows from `start` on, in key order: each task keeps k rows, and only those meet."""
    return state.where(F.col("k") >= start).orderBy("k").limit(max(0, k))


def iterate(state: DataFrame, start: str) -> DataFrame:
    """All rows from `start` on with their position in key order, counted from 0. `toLocalIterator` reads them as a cursor."""
    return with_rank(state.where(F.col("k") >= start), "k", "position")


def project(state: DataFrame, *columns: str) -> DataFrame:
    """The key and some columns; the others are never read."""
    return state.select("k", *columns)
