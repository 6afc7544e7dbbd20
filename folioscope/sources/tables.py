"""Parquet table access shared by all queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory (one file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
