"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The session's own folder; a local one is set only where there is none."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="boscage-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """df written once as Parquet and read again; cuts the lineage."""
    spark = df.sparkSession
    path = path or f"{folder(spark)}/boscage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
