"""Benchmark run logs as tables of text lines.

Spark reads text files in splits, so a line's place in its file is not known
afterwards. Lines therefore carry their query and sequence number:
``query<TAB>seq<TAB>text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

col = F.col


def read_run_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(query, seq, line)."""
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).select(
        parts[0].alias("query"), parts[1].cast("long").alias("seq"), parts[2].alias("line")
    )


def write_run_log(lines: DataFrame, path: str) -> None:
    lines.select(F.concat_ws("\t", "query", col("seq").cast("string"), "line")).write.text(path)
