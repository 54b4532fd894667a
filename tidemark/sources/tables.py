"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
