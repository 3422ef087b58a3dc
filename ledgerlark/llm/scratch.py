"""Lineage cuts: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


class Scratch:
    """Written tables of one operator run; a table can be dropped as soon as its successor is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """df as a written table, read back: a lost executor costs a re-read, not a recomputation."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.option("compression", compression).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._delete(path)

    def keep(self, *frames: DataFrame) -> None:
        """Drops every written table but these, whose lineage does not need the others."""
        paths = {getattr(df, "_scratch_path", None) for df in frames}
        for n in range(1, self.n + 1):
            path = f"{self.root}/{n:04d}"
            if path not in paths:
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
