"""Storing intermediate tables where all executors can read them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.  Only a session
    on one machine that names none gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = getattr(shared_folder, "own", None)
    if folder is None:
        folder = shared_folder.own = tempfile.mkdtemp(prefix="palisade-")
    return folder


# tables that stored() has written in this process, and inside scratch() of a thread
_written: list[str] = []
_open = threading.local()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that stored() has written, when no result that reads them is needed any more."""
    _delete(spark, _written)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside are deleted at the end."""
    outer, own = getattr(_open, "paths", None), []
    _open.paths = own
    try:
        yield
    finally:
        _open.paths = outer
        _delete(spark, own)


def stored(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, and read it back: it is
    computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/palisade-{uuid.uuid4().hex}"
    (_written if getattr(_open, "paths", None) is None else _open.paths).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
