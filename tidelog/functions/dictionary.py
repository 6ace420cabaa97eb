"""Order-preserving dictionaries: codes compare as their strings do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ordinals import with_rank


#: Dictionaries of so many values are numbered on the driver, larger ones as a table.
FEW = 1_000


def build(values: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values in byte order, numbered from 0; '' and null are absent values and get no code.

    Values are counted up to FEW first: so few are put in order here and become literals, more are ranked as a table.
    """
    distinct = values.select(F.col(column).alias("value")).where("value <> ''").distinct()
    few = sorted((r[0] for r in distinct.limit(FEW + 1).collect()), key=str.encode)
    if 0 < len(few) <= FEW:
        pairs = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(i).alias("code")) for i, v in enumerate(few)])
        return values.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.value", "p.code")
    return with_rank(distinct, "value", "code").select("value", F.col("code").cast("int").alias("code"))


def merge(*dictionaries: DataFrame) -> DataFrame:
    """One dictionary of all values, numbered anew."""
    every = dictionaries[0].select("value")
    for d in dictionaries[1:]:
        every = every.union(d.select("value"))
    return build(every, "value")


def encode(df: DataFrame, column: str, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """Add the code of a column, -1 for absent or unknown values. Small dictionaries are broadcast by their measured size."""
    d = dictionary.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(d, df[column] == d["__v"], "left").withColumn(code, F.coalesce("__c", F.lit(-1))).drop("__v", "__c")


def decode(df: DataFrame, code: str, dictionary: DataFrame, column: str = "value") -> DataFrame:
    """Add the string of a code, '' for -1 or an unknown code."""
    d = dictionary.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(d, df[code] == d["__c"], "left").withColumn(column, F.coalesce("__v", F.lit(""))).drop("__v", "__c")


def remap(dictionaries: DataFrame, merged: DataFrame) -> DataFrame:
    """(run, old_code, new_code) for dictionaries (run, value, code) merged into one."""
    new = merged.select("value", F.col("code").alias("new_code"))
    return dictionaries.join(new, "value").select("run", F.col("code").alias("old_code"), "new_code")


def bounds(dictionary: DataFrame, predicate: Column) -> DataFrame:
    """One row (lo_code, hi_code) of the codes whose values satisfy a predicate; nulls, and so no match, if none does."""
    return dictionary.where(predicate).agg(F.min("code").alias("lo_code"), F.max("code").alias("hi_code"))
