"""Parquet tables by name, one folder or file ``{name}.parquet`` each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` below ``base``; Spark raises if it does not exist."""
    return spark.read.parquet(table_path(base, name))
