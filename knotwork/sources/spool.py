"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="knotwork-")


def folder(spark: SparkSession) -> str:
    """The shared folder; in local mode, where none is set, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the driver's Python ends."""
    path = f"{folder(spark)}/knotwork-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def spool(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and read back: cuts the lineage; the files survive lost executors and go at exit."""
    return read(df, write(df, name))


def write(df: DataFrame, name: str = "table") -> str:
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return path


def read(like: DataFrame, *paths: str) -> DataFrame:
    """What was written from frames with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass
