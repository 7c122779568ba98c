"""Where tables that jobs write for themselves go: a folder that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a
    temporary folder on a local master and the warehouse on any other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        base = "file://" + os.path.join(tempfile.gettempdir(), "lexforge-work") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lexforge_work"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
