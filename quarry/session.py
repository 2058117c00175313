"""SparkSession defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "quarry", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on. On a cluster, pass your own session instead."""
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a temporary one; a cluster, whose machines don't share such folders, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.shared.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.shared.dir", path)
    return path.rstrip("/")
