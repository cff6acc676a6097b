"""Queries whose point is the user function: each equals a native query's result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import geometric_mean
from ..functions.udfs import (
    PRICING_INPUTS,
    TRANSPORTS,
    call_struct,
    call_struct_sql,
    geometric_mean_batches,
    lookup_in_tasks,
    norm_cdf_udf,
    price_progress,
    price_step,
    pricing_udf,
    string_batch_udf,
)
from ..operators.reports import function_overhead
from ..operators.row_kernels import KERNELS, overhead
from ..sources.tables import table
from .generated import kernel_input, priced_lines

col = F.col
Query = Callable[[SparkSession, str], DataFrame]
STRINGS = 8
REPORT_EVERY = 100


def price_rows(spark: SparkSession, sf_dir: str, transport: str) -> DataFrame:
    lines = priced_lines(spark, sf_dir)
    return _without_timing(call_struct(lines, pricing_udf(transport), PRICING_INPUTS))


def price_rows_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = priced_lines(spark, sf_dir)
    return _without_timing(call_struct_sql(spark, lines, pricing_udf("row"), PRICING_INPUTS))


def _without_timing(df: DataFrame) -> DataFrame:
    return df.drop("py_duration").select("*", overhead())


def pricing_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pricing kernel by every transport and natively, each in one observed pass: mean time in the
    function, mean overhead and rows per second, beside what the pass computed."""
    lines = priced_lines(spark, sf_dir)
    computed = {"passed": F.sum("passed_filter"), "charged_cents": F.sum(F.rint(col("charge") * 100).cast("long"))}
    reports = [
        function_overhead(call_struct(lines, pricing_udf(transport), PRICING_INPUTS), transport, "py_duration", computed)
        for transport in TRANSPORTS
    ]
    native = KERNELS["tpch_q1"](lines).withColumn("py_duration", F.lit(None).cast("long"))
    reports.append(function_overhead(native, "native", "py_duration", computed))
    return reduce(DataFrame.unionAll, reports)


def pricing_overhead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the times, but whether they are there and add up."""
    report = pricing_overhead(spark, sf_dir)
    had = col("wall_s") * col("at_once") * 1e9 / col("rows")
    sums = F.abs(col("mean_function_ns") + col("mean_overhead_ns") - had) < 1e-6 * had
    called = (col("mean_function_ns") > 0) == (col("tag") != "native")
    return report.select("tag", "rows", "passed", "charged_cents", (sums & called & (col("rows_per_s") > 0)).alias("timed"))


def cdf_rows(spark: SparkSession, sf_dir: str, transport: str) -> DataFrame:
    values = kernel_input(spark, sf_dir, "norm_cdf")
    result = norm_cdf_udf(transport)("v")
    return values.select(
        col("v").alias("input_val"), F.round(result, 8).alias("cdf_result"), overhead()
    )


def strings_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kernel_input(spark, sf_dir, "str16")
    inputs = [f"s_in{i}" for i in range(1, STRINGS + 1)]
    return call_struct(rows, string_batch_udf(STRINGS), inputs).select("*", overhead())


def customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(
        col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    return lookup_in_tasks(customers, nations, "c_nationkey", "n_name")


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (id, price)."""
    return table(spark, sf_dir, "events").select(
        col("event_id").alias("id"), col("value").alias("price")
    )


def priced_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = event_prices(spark, sf_dir).withColumn(
        "start_ns", F.unix_micros(F.current_timestamp()) * 1000
    )
    return price_step(stamped).select("id", "price")


def progress_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running report of each kind of event and day, every hundred events and at the end."""
    part = F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd"))
    return price_progress(table(spark, sf_dir, "events"), part, col("event_id"), col("value"), REPORT_EVERY).drop("spent_ns")


def priced_natively(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_prices(spark, sf_dir).select("id", (col("price") + 1.0).alias("price"))


def geomeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    means = events.groupBy("event_type").agg(geometric_mean(col("value")).alias("geomean"))
    return means.select("event_type", F.round("geomean", 6).alias("geomean"))


def geomeans_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = geometric_mean_batches(table(spark, sf_dir, "events"), "event_type", "value")
    return means.select("event_type", F.round("geomean", 6).alias("geomean"))


def queries() -> dict[str, Query]:
    return {
        "x_str16_arrow": strings_in_batches,
        "udf_overhead": pricing_overhead,
        "udf_overhead_rows": pricing_overhead_rows,
        "udf_scalar_struct": price_rows_sql,
        "udf_arrow_scalar": lambda spark, sf_dir: price_rows(spark, sf_dir, "arrow"),
        "udf_pandas_struct": lambda spark, sf_dir: price_rows(spark, sf_dir, "pandas"),
        "udf_row_norm_cdf": lambda spark, sf_dir: cdf_rows(spark, sf_dir, "row"),
        "udf_pandas_norm_cdf": lambda spark, sf_dir: cdf_rows(spark, sf_dir, "pandas"),
        "udf_closure_lookup": customer_nations,
        "udtf_price": priced_by_table_function,
        "udtf_price_progress": progress_of_prices,
        "udf_timed_java_equiv": priced_natively,
        "udaf_geomean": geomeans,
        "udaf_geomean_pandas": geomeans_in_batches,
    }
