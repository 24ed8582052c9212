"""Table access by directory and name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (one file or a folder of parts)."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))
