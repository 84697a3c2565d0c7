"""Staging of intermediate tables that a plan reads more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, on storage that all executors share.

    Only a session whose tasks run inside the driver process (a local master, as in tests)
    may leave it unset; it then gets one temporary folder. On a cluster an unset folder is
    an error, because each executor would write to its own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        master = context.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(
                "spark.checkpoint.dir is not set: name a folder on storage that the driver"
                " and all executors share"
            )
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint a table that many jobs reuse, in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the files are columnar: later reads take only the columns they
    need, and filters reach the scan. Each call writes a new folder, so a job that is run
    again never meets rows of an earlier one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    What stands in exploded or staged rows cannot be told from the size of the files that
    they come from, so a broadcast chosen by that size may not fit into the driver.
    """
    return df.hint("merge")
