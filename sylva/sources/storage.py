"""Where intermediate files go, and where Python workers find this package."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; where it is unset, in a folder of its
    own if all run in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="sylva-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/sylva/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate files of this application, once its results are written."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/sylva/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def on_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, unless it was shipped to them."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
