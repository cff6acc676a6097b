"""The price stream: stamp each row, step the price, report the time it took."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import price_step
from ..operators.reports import overhead_by_batch
from ..sources.workspace import fresh_folder
from .runs import finish

col = F.col


def stamped(prices: DataFrame) -> DataFrame:
    """Add the start of the row's micro-batch in nanoseconds."""
    return prices.withColumn("start_ns", F.unix_micros(F.current_timestamp()) * 1000)


def stepped(prices: DataFrame) -> DataFrame:
    """(id, price + 1, round trip, Python time, the rest), in nanoseconds per row.

    Three stages: stamp, the Python table function in a lateral join, and the
    overhead struct that is unpacked into the sink's columns.
    """
    processed = price_step(stamped(prices.select("id", "price")))
    round_trip = col("end_ns") - col("start_ns")
    result = F.struct(
        "price",
        round_trip.alias("totalRoundTrip"),
        col("py_duration").alias("pyDurationNs"),
        (round_trip - col("py_duration")).alias("overhead"),
    )
    return processed.select("id", result.alias("r")).select("id", "r.*")


def stepped_natively(prices: DataFrame) -> DataFrame:
    return prices.select("id", (col("price") + 1).alias("price"))


def valued(prices: DataFrame, idle: bool = False) -> DataFrame:
    """price * quantity + ln(1 + price), or the price as it came when idle."""
    value = col("price") if idle else col("price") * col("quantity") + F.log(col("price") + 1)
    return prices.select("id", value.alias("value"))


def step_overhead(prices: DataFrame, timeout_s: float | None = None) -> DataFrame:
    """What the Python table function costs, by micro-batch: (batch, rows, mean_function_ns,
    mean_overhead_ns, rows_per_s). The stream is run to its end and its rows are discarded; a batch's
    sums are observed as it runs. Batches are as large as the source makes them."""
    name = "price step"
    observed = stepped(prices).observe(name, F.count(F.lit(1)).alias("rows"), F.sum("pyDurationNs").alias("function_ns"))
    found: dict[int, dict] = {}

    def watch(progress: list) -> None:
        found.update({row["batch"]: row for row in overhead_by_batch(progress, name)})

    spark = prices.sparkSession
    finish(observed.writeStream.format("noop"), fresh_folder(spark, "overhead"), timeout_s, watch=watch)
    columns = "batch long, rows long, mean_function_ns double, mean_overhead_ns double, rows_per_s double"
    return spark.createDataFrame([tuple(row.values()) for row in found.values()], columns)
