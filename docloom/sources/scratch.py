"""Folders for files that a job writes and reads again, where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; in local mode one of its own where that is not set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"
