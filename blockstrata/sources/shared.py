"""What driver and executors share: the folder, and tables that are computed once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """A small table that several plans use, computed once: checkpointed where a folder for that is set, else kept."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; below a temporary one only where that is unset and all runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="strata-"))
        base = _OWN[0]
    path = os.path.join(base.removeprefix("file://").removeprefix("file:"), "strata", f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path
