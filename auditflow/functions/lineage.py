"""Folders that the whole cluster shares, and results written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where none is set a temporary folder serves a local session; on a cluster that is an
    error, as executors would not see it.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="auditflow-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A name for a new folder in the shared one."""
    return f"{shared(spark)}/auditflow-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, for results that are read several times."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a new Parquet folder of the shared one, and read from there.

    A checkpoint computes its rows twice unless they are cached; this does not.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and merged, never broadcast.

    Spark sizes a table by the columns it was read from.  What is generated from them, such as
    an array of findings or the tokens of a text, may be hundreds of times larger, and would be
    collected on the driver to be broadcast.
    """
    return df.hint("merge")


def state_of(table: DataFrame) -> tuple[int, str]:
    """What a table read from files stands on: how many files, and a sum over their names, times and sizes.

    It changes whenever a file is added, removed or rewritten; no column is read.
    """
    files = table.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    return tuple(files.select(F.xxhash64(*files.columns).cast("decimal(20)").alias("h")).agg(
        F.count("h"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")).first())
