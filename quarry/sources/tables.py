"""Loading of the driver's Parquet tables by name, through Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the path may be a file, a folder of files or any URI that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
