"""Spark sessions with the settings that results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "assaymill", cores: int | str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A local session: UTC, ANSI arithmetic, adaptive execution, as many shuffle partitions as asked for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ASSAYMILL_DRIVER_MEMORY", "6g"))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
