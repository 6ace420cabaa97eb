"""Merges of sorted runs: the newest version of a key wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import newest


def union_runs(*runs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def first_wins(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Rows of `newer`, and those of `older` whose key it lacks."""
    return newer.unionByName(older.join(newer.select("k"), "k", "left_anti"))


def compact(*runs: DataFrame, bottom: bool, oldest_open: int | None = None) -> DataFrame:
    """Merge runs into one log. At the bottom level tombstones go. With an open snapshot, the newest version it can see of each
    key stays as well, whatever came after."""
    log = union_runs(*runs)
    kept = newest(log)
    if oldest_open is not None:
        seen = newest(log.where(F.col("epoch") <= oldest_open))
        kept = kept.unionByName(seen).distinct()
        bottom = False
    return kept.where(~F.col("deleted")) if bottom else kept
