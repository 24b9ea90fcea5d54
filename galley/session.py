"""Session factory and table access shared by every plan."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(app: str = "galley", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the plans assume: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GALLEY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # tables that settled() keeps go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``, for plans that use it many times.

    In local mode a temporary folder is set where there is none. With ``spark.cleaner.referenceTracking.cleanCheckpoints``, which
    :func:`get_session` sets, Spark deletes the table once no plan refers to it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-galley-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(path: str) -> str | None:
    """A path without its ``file:``, or None if it names another file system."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) is None:
        return path
    return re.sub("^file:(?://)?", "", path) if path.startswith("file:") else None
