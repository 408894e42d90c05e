"""Session settings."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **options: str) -> SparkSession:
    own = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=own | options).getOrCreate()


def checkpointed(spark: SparkSession) -> SparkSession:
    """spark with a checkpoint folder: the one in spark.checkpoint.dir; only a local session without one gets its own."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="residua-checkpoint-"))
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """spark whose Python workers find this package where it lies; on a cluster it is shipped with --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
