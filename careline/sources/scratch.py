"""Folders and tables of intermediate results, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, kind: str = "streams") -> str:
    """A new folder below ``spark.checkpoint.dir``, which a cluster names. Only a local session without that setting
    uses a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="careline-")
    return f"{root.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table that is written once and read again: it cuts the lineage, is worked out once however often it
    is used, and survives lost executors."""
    path = f"{work_folder(df.sparkSession, 'tables')}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
