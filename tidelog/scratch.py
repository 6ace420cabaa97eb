"""Tables in the folder that the driver and all executors share, written to cut lineage and to fix what is read twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where the setting is absent, a session on one machine gets a folder of its own;
    a cluster is refused, as its executors would not see the driver's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to the shared folder: a lost executor re-reads them instead of recomputing what came before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
        self.n = 0

    def settle(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidelog_path = path
        return out

    def named(self, df: DataFrame, settled: DataFrame) -> DataFrame:
        """`df` as a view of a settled table, so that it can be dropped."""
        df._tidelog_path = settled._tidelog_path
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tidelog_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
