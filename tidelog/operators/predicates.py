"""Value predicates, on strings or on dictionary codes. All of them stand above newest-per-key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import dictionary as D
from tidelog.functions.ordinals import with_rank


def value_range(state: DataFrame, column: str, lo: str, hi: str) -> DataFrame:
    """lo <= value <= hi in byte order; absent values ('' or null) never match, inverted bounds match nothing."""
    return state.where((F.col(column) != "") & F.col(column).between(lo, hi))


def code_range(encoded: DataFrame, code: str, dictionary: DataFrame, lo: str, hi: str) -> DataFrame:
    """The same range on an encoded column: the dictionary gives the code bounds, and rows compare integers."""
    return by_codes(encoded, code, D.bounds(dictionary, F.col("value").between(lo, hi)))


def by_codes(encoded: DataFrame, code: str, bounds: DataFrame) -> DataFrame:
    """The bounds (one row) are looked up first, so that the filter holds two numbers, which a scan can push down."""
    lo, hi = bounds.first()
    return encoded.where(F.lit(False) if lo is None else F.col(code).between(lo, hi))


def monotone(encoded: DataFrame, code: str, dictionary: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Any predicate that flips once along the value order, evaluated on the distinct values only."""
    return by_codes(encoded, code, D.bounds(dictionary, predicate(F.col("value"))))


def late_values(selected: DataFrame, code: str, dictionary: DataFrame, column: str) -> DataFrame:
    """Decode the codes of rows that survived the filters."""
    return D.decode(selected, code, dictionary, column).drop(code)


def batches(state: DataFrame, selected: Column, rows: int = 2048) -> DataFrame:
    """(batch, n_rows, n_selected) for every `rows` rows in key order."""
    numbered = with_rank(state.select("k", selected.alias("s")), "k", "at")
    return numbered.groupBy(F.floor(F.col("at") / rows).cast("int").alias("batch")).agg(F.count("*").alias("n_rows"), F.count_if("s").alias("n_selected"))
