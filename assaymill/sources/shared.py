"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets a temporary folder, a cluster must name one."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="assaymill-main-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        context.setCheckpointDir(place)
    return place


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once: written as Parquet to a folder of their own and read again."""
    place = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)
