"""Intermediate tables in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where the session
names none (tests, a laptop) a local folder is made and set.  A written table
cuts the lineage like a reliable checkpoint does, is compressed and column
pruned, and survives the loss of the executors that wrote it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one is set only if the session has none."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="boscage-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


class Scratch:
    """Named tables of one run of an operator.

    What a returned DataFrame still reads stays until remove() or until the
    driver's file system is closed, at the end of the application.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/boscage-{name}-{uuid.uuid4().hex}"
        self.marked = False
        Scratch.opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return the written table."""
        df.write.mode("errorifexists").option("compression", "lz4").parquet(self.path(name))
        self.mark()
        return self.read(name, df)

    def mark(self) -> None:
        """Have the folder deleted when the application ends."""
        if not self.marked:
            path, fs = self._at(self.root)
            self.marked = bool(fs.deleteOnExit(path))

    def _at(self, path: str) -> tuple:
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return own, own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def remove(self) -> None:
        """Delete all tables."""
        path, fs = self._at(self.root)
        fs.delete(path, True)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path, fs = self._at(self.path(name))
            fs.delete(path, True)


def width(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: str, share: int = 1000) -> DataFrame:
    """rows joined with a written table of a row per group and its number of rows n.

    Groups that hold more than one in ``share`` of all rows are fewer than
    ``share``: these are broadcast, so no task takes a hot group; the others
    are joined by a shuffle.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = groups.where(F.col(n) * share > F.lit(int(total)))
    if total < share * share or not hot.limit(1).count():
        return rows.join(groups, on)
    few = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col(n) * share <= F.lit(int(total))), on)
    return few.unionByName(rows.join(F.broadcast(hot), on))
