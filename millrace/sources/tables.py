"""The given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .workspace import file_system

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}, expected one of {TABLES}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Path, size, number of files and time of the last change of a table: what tells whether it has changed."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    system, target = file_system(spark, path)
    content = system.getContentSummary(target)
    return path, content.getLength(), content.getFileCount(), system.getFileStatus(target).getModificationTime()


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table. Parquet answers this from its footers, no column is read."""
    return table(spark, sf_dir, name).count()
