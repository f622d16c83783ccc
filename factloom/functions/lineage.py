"""Cutting lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session on one machine may do without the setting; it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Folder:
    """Parquet tables of one computation in the shared folder. They survive lost executors and go with the driver."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)  # what isn't there can't be marked
        fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str, counted: Column | None = None) -> tuple[DataFrame, int]:
        """The rows from a table of their own, and how many there are, or how many meet a condition."""
        df.write.parquet(f"{self.root}/{name}")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        return kept, (kept if counted is None else kept.where(counted)).count()

    def read(self, pattern: str, schema) -> DataFrame:
        """All tables of a pattern of names."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{pattern}")
