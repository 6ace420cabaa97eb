"""Sorted runs as Parquet with dictionary codes, and the manifest that lists them.

A run holds the versions of one key range, sorted by key: `k`, the value columns, a code for each of them (`c1#`; -1: no value),
epoch, seq, deleted. Codes of a column compare as its strings do within one run, so that a range on a column is a range of codes,
which a scan can push down; the strings are read for what is selected only. The run's dictionary is a table beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.ordinals import with_rank
from tidelog.model import SYSTEM, Options, value_columns

MANIFEST = "level int, run_id string, path string, key_min string, key_max string, key_num long, n_versions long, bytes long, max_epoch long"

Predicate = Callable[[Column], Column]


def run_schema(schema: T.StructType) -> T.StructType:
    """The columns of a run for a log's: after each value column its code."""
    fields = []
    for f in schema.fields:
        fields += [f] if f.name == "k" or f.name in SYSTEM else [f, T.StructField(f"{f.name}#", T.IntegerType())]
    return T.StructType(fields)


def write_runs(log: DataFrame, root: str, versions: int, options: Options = Options()) -> list[dict]:
    """Write a log of about `versions` rows as runs that part the key range, at most about `options.rows_per_run` rows each, with
    their dictionaries. Gives the path and the statistics of each, as in the manifest; none for an empty log.

    All versions of a key are in one run. Codes are dense ranks inside a run, so that every sort holds one run at most.
    """
    columns, n = value_columns(log), max(1, -(-versions // options.rows_per_run))
    base = f"{root}/{uuid.uuid4().hex}"
    coded = log.repartitionByRange(n, "k").withColumn("part", F.spark_partition_id()).repartition(n, "part")
    for c in columns:
        there = F.coalesce(F.col(c) != "", F.lit(False))
        rank = F.dense_rank().over(Window.partitionBy("part").orderBy(F.when(there, 0).otherwise(1), F.when(there, F.col(c))))
        coded = coded.withColumn(f"{c}#", F.when(there, rank - 1).otherwise(-1).cast("int"))
    ordered = coded.select("part", *run_schema(log.schema).fieldNames()).sortWithinPartitions("part", "k", "epoch", "seq")
    writer = ordered.write.partitionBy("part").option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.fpp#k", str(options.false_positive))
    writer.option("parquet.page.size", str(options.block_bytes)).parquet(f"{base}/runs")
    written = read_parts(log.sparkSession, f"{base}/runs", run_schema(log.schema))
    if columns:
        values = [written.where(F.col(f"`{c}#`") >= 0).select("part", F.lit(c).alias("col"), F.col(c).alias("value"), F.col(f"`{c}#`").alias("code")).distinct() for c in columns]
        every = reduce(DataFrame.unionAll, values).repartition(n, "part").sortWithinPartitions("part", "col", "code")
        every.write.parquet(f"{base}/dictionaries")
    return [{"path": f"{base}/runs/part={part}"} | d for part, d in describe(written, "part").items()]


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def name_of(run: str) -> tuple[str, int]:
    """The folder that a run was written to with others, and its number there."""
    folder, _, part = run.rsplit("/", 2)
    return folder.rsplit("/", 1)[-1], int(part.removeprefix("part="))


def code_bounds(spark: SparkSession, paths: list[str], predicates: dict[str, Predicate]) -> dict[str, dict[str, tuple[int, int]]]:
    """For each run with a value for every predicate: the range of codes that satisfies it, by column.

    Predicates are read off the dictionaries: ranges, or others that flip once along the order of values. One job over the
    dictionaries of all runs; a row comes back for each run and column. A run left out holds no match at all.
    """
    if not paths:
        return {}
    folders = sorted({p.rsplit("/", 2)[0] + "/dictionaries" for p in paths})
    values = spark.read.schema("part int, col string, value string, code int").parquet(*folders).withColumn("path", F.col("_metadata.file_path"))
    wanted = reduce(Column.__or__, [(F.col("col") == c) & p(F.col("value")) for c, p in predicates.items()])
    folder = F.regexp_extract("path", r"([^/]+)/dictionaries/", 1)
    found = values.where(wanted).groupBy(folder.alias("folder"), "part", "col").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).collect()
    by = {name_of(p): p for p in paths}
    out: dict[str, dict[str, tuple[int, int]]] = {}
    for r in found:
        if run := by.get((r["folder"], r["part"])):
            out.setdefault(run, {})[r["col"]] = (r["lo"], r["hi"])
    return {p: b for p, b in out.items() if len(b) == len(predicates)}


def scan_codes(spark: SparkSession, schema: T.StructType, bounds: dict[str, dict[str, tuple[int, int]]]) -> DataFrame:
    """The versions whose codes lie in the bounds of their run, as a log. What holds for all runs is pushed down to the files as
    integer comparisons; where runs differ, each row meets the bounds of its run, a row for each run."""
    rows = spark.read.schema(run_schema(schema)).parquet(*bounds)
    columns = sorted({c for b in bounds.values() for c in b})
    for c in columns:
        rows = rows.where(F.col(f"`{c}#`").between(min(b[c][0] for b in bounds.values()), max(b[c][1] for b in bounds.values())))
    if len({tuple(sorted(b.items())) for b in bounds.values()}) > 1:
        names = [(f"__lo{i}", f"__hi{i}") for i in range(len(columns))]
        table = spark.createDataFrame([("/".join(p.rsplit("/", 3)[1:]), *(x for c in columns for x in b[c])) for p, b in bounds.items()], "__run string, " + ", ".join(f"{x} int" for pair in names for x in pair))
        rows = rows.withColumn("__run", F.regexp_extract("_metadata.file_path", r"([^/]+/runs/part=\d+)/", 1)).join(F.broadcast(table), "__run")
        for c, (lo, hi) in zip(columns, names, strict=True):
            rows = rows.where(F.col(f"`{c}#`").between(F.col(lo), F.col(hi)))
    return rows.select(*schema.fieldNames())


def block_index(state: DataFrame, rows: int) -> DataFrame:
    """(block, key_min, n_rows) for every `rows` rows in key order."""
    numbered = with_rank(state.select("k"), "k", "at")
    return numbered.groupBy(F.floor(F.col("at") / rows).cast("int").alias("block")).agg(F.min("k").alias("key_min"), F.count("*").alias("n_rows"))


def describe(log: DataFrame, by: str | None = None) -> dict:
    """Statistics of a written log, or of each of its runs: the narrow columns are read once, values are not."""
    by_column = F.col(by) if by else F.lit(0)
    rows = log.select(by_column.alias("by"), "k", "epoch", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    # A key's versions are counted together first, so that no set of keys is held for a run.
    keys = rows.groupBy("by", "k").agg(F.count("*").alias("n"), F.max("epoch").alias("epoch"), F.max("file").alias("file"), F.max("size").alias("size"))
    files = keys.groupBy("by", "file").agg(F.max("size").alias("bytes"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("keys"), F.sum("n").alias("n"), F.max("epoch").alias("epoch"))
    found = files.groupBy("by").agg(F.min("lo"), F.max("hi"), F.sum("keys"), F.sum("n"), F.sum("bytes"), F.max("epoch")).collect()
    names = ("key_min", "key_max", "key_num", "n_versions", "bytes", "max_epoch")
    return {r[0]: dict(zip(names, r[1:], strict=True)) for r in found}
