"""Text sources and sinks: CSV, TSV, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None, tab: bool = False) -> DataFrame:
    """With a header row; give a schema for large files, or types cost a pass of their own."""
    reader = spark.read.option("header", True).option("sep", "\t" if tab else ",")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, tab: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if tab else ",").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
