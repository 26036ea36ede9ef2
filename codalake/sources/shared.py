"""A folder that driver and executors share, for tables and files that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir; a local folder only where none is set and the master is local."""
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        sc.setCheckpointDir(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"
