"""Folders that the driver and all executors share, for what is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no shared folder and runs on this machine alone, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a default, and any other one an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master or ""
    if master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SHARED_DIR


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/tessera/{uuid.uuid4().hex}/{name}"
