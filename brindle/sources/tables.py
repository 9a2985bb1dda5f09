"""Tables in files, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns of what follows reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a local master without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/brindle/{uuid.uuid4().hex}-{label}"


def stored(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> DataFrame:
    """Write a table as parquet, orc, json or csv, in a folder per value of ``by``, and read it with its own schema.

    Texts come back as they were, but for an empty one in ``by`` and ``\\N`` in csv,
    which come back as null.  A csv file is one task's work, as line ends in texts
    forbid to split it.
    """
    options = {}
    if form == "csv":
        options = {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    writer = df.write.format(form).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)
    return df.sparkSession.read.format(form).options(**options).schema(df.schema).load(path)
