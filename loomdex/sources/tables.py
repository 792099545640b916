"""Readers for the Parquet tables of a data folder, and the ways to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named table; with ``columns`` only those, so that the scan reads no other."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns.

    It is one aggregation with partial combining, so a key that holds a third of
    all rows is reduced before the shuffle. Rows that tie in ``order`` are told
    apart by their whole content, so the result doesn't depend on arrival.
    """
    plain = [c for c, t in df.dtypes if c not in keys and "map<" not in t]
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) for o in order], *[F.col(c) for c in plain if c not in order])
    best = F.max_by(F.struct(*others), rank)
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset and driver and executors are one process, as in tests, a temporary one is made and set; on a cluster
    a folder of one machine would lose data, so that is a RuntimeError.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(?:\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomdex-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that this process has written and not yet removed.
_written: list[str] = []


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; unlike cut() it is columnar and compressed. See forget()."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _written.append(path)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(spark: SparkSession) -> int:
    """Removes what written() has left in the shared folder, and says how many tables that were. To be called when no result that rests on them is needed any more."""
    n = len(_written)
    while _written:
        Files(spark, _written.pop()).remove()
    return n


class Files:
    """A path on any file system that Spark can reach, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark, self.path = spark, path

    def child(self, name: str) -> Files:
        return Files(self.spark, f"{self.path.rstrip('/')}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        """What is in the folder, in order; nothing if there is none."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path)) if self.exists() else []

    def read(self) -> str:
        """The text of a small file; FileNotFoundError where there is none."""
        if not self.exists():
            raise FileNotFoundError(self.path)
        stream = self._fs.open(self._path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str) -> None:
        """Makes a small file with the text; FileExistsError if another has made it before."""
        try:
            stream = self._fs.create(self._path, False)
        except Py4JJavaError as e:
            raise FileExistsError(self.path) from e
        stream.write(bytearray(text.encode()))
        stream.close()

    def make(self) -> None:
        self._fs.mkdirs(self._path)

    def remove(self) -> None:
        """Removes a file or a folder with all that is in it; one that isn't there is no error."""
        self._fs.delete(self._path, True)
