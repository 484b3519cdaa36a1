"""Tables written on the way, so that loops and plans with many uses of one result start from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder ``spark.checkpoint.dir``; in a temporary folder in local mode, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillgraph/kept-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def discarded(*frames: DataFrame) -> None:
    """Delete tables that ``kept`` wrote, once nothing reads them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
