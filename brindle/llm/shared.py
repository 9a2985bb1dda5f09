"""What the corpus operators share: scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the maximal runs of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only after its rows are counted, and its files' bytes, and found to be at most so many.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32_000_000

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing (tests on one machine) a temporary folder is
    made and set; on a cluster the setting is the operator's duty.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/brindle/{uuid.uuid4().hex}-{label}"
    _written.append(path)
    return path


def filesystem_of(uri: str):
    """(pyarrow file system, path) of a folder that all executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def token() -> str:
    """A name that no other run uses."""
    return uuid.uuid4().hex


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and return a frame that reads it.

    It cuts the lineage: what follows survives lost executors without the work
    before.  The files stay until ``clean``.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``docs`` with names of their own for all columns but ``keep``, so that none clashes with an operator's columns."""
    return docs.select(*[F.col(c).alias(c if c in keep else f"aside_{k}") for k, c in enumerate(docs.columns)])


def back(out: DataFrame, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` again."""
    return out.select(*[F.col(c if c in keep else f"aside_{k}").alias(c) for k, c in enumerate(docs.columns)])


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Add to ``paths`` the scratch tables that are made meanwhile."""
    begin = len(_written)
    try:
        yield
    finally:
        paths += _written[begin:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder and empty the list; frames that read them end."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    while paths:
        name = paths.pop()
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _written:
            _written.remove(name)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this session; frames that read them end."""
    delete(spark, list(_written))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (already written) table has few rows and bytes; otherwise the frame as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the written files
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= rows else df
