"""Scalar functions on keys and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.model import KEY_SIZE


def fixed(key: Column, size: int = KEY_SIZE) -> Column:
    """The key as `size` bytes: cut, or filled up with NUL."""
    return F.rpad(F.substring(key, 1, size), size, "\0")


def unfixed(key: Column) -> Column:
    return F.rtrim(key, F.lit("\0"))


def power(base: Column, exponent: Column) -> Column:
    return F.pow(base, exponent).cast("long")


def highest_bit(x: Column) -> Column:
    """Position of the highest bit set, from 0; null for numbers below 1."""
    return F.when(x >= 1, F.length(F.bin(x)) - 1)
