"""Tables that a query writes for itself, to be read more than once or to cut a long lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder (tests); on a cluster there is none that all could see: an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The tables of the innermost :func:`temporary_tables`.
_MADE: list[list[str]] = []


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read back.

    A lost executor then costs a re-read, not a re-run of everything before.  The files go at the end of the
    :func:`temporary_tables` around, unless keep, or else when the application ends.  compression: of Parquet, instead of the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    if _MADE and not keep:
        _MADE[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end; results that are to outlast it are saved inside with keep."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            at, fs = _at(spark, path)
            fs.delete(at, True)
