"""A load source: numbered rows with random prices and quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def datagen_stream(
    spark: SparkSession,
    rows: int,
    rows_per_batch: int | None = None,
    partitions: int | None = None,
    seed: int = 7,
    rows_per_second: int | None = None,
) -> DataFrame:
    """(id 1..rows, price in [1, 100), quantity 1..10), at so many rows a batch or a second.

    The source itself never ends; rows past the last id are filtered out.
    """
    if (rows_per_batch is None) == (rows_per_second is None):
        raise ValueError("give either rows_per_batch or rows_per_second")
    if rows_per_second is None:
        reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
    else:
        reader = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    source = reader.option("numPartitions", partitions or spark.sparkContext.defaultParallelism).load()
    return source.filter(F.col("value") < rows).select(
        (F.col("value") + 1).cast("long").alias("id"),
        (F.rand(seed) * 99 + 1).alias("price"),
        (F.floor(F.rand(seed + 1) * 10) + 1).cast("int").alias("quantity"),
    )
