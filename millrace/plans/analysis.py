"""Sources, run reports and benchmark comparison, bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import hundredths
from ..operators import reports
from ..operators.row_kernels import KERNELS
from ..sources.bench_results import read_bench_results, write_result_lines
from ..sources.run_logs import read_run_log, write_run_log
from ..sources.split_documents import read_large_results, write_large_results
from ..sources.tables import TABLES, row_count, table
from ..sources.workspace import fresh_folder
from .row_inputs import row_input

col = F.col
Query = Callable[[SparkSession, str], DataFrame]


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every given table."""
    counts = [
        table(spark, sf_dir, name)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows")
        for name in TABLES
    ]
    return reduce(DataFrame.unionAll, counts)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as benchmark measurements (file, benchmark, value) in seconds.

    The day is the file; a benchmark is an event type at one of four magnitudes.
    """
    magnitude = F.pmod("user_id", F.lit(4)).cast("int")
    scale = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1e3, 1e6, 1e9)]), magnitude + 1)
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("file"),
        F.concat_ws("_", "event_type", magnitude.cast("string")).alias("benchmark"),
        (col("value") / scale).alias("value"),
    )


def measured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as result documents and read back."""
    path = fresh_folder(spark, "bench-results")
    write_result_lines(
        table(spark, sf_dir, "events").select(
            F.date_format("ts", "yyyy-MM-dd").alias("file"),
            col("event_type").alias("benchmark"),
            "value",
            col("event_id").alias("seq"),
        ),
        path,
    )
    return read_bench_results(spark, path, multi_line=False, file_column="file")


def measured_in_large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as few large documents and read back, each by several tasks once it is large.
    The day goes into the name of the benchmark."""
    path = fresh_folder(spark, "large-results")
    name = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), "event_type")
    write_large_results(
        table(spark, sf_dir, "events").select(name.alias("benchmark"), "value", col("event_id").alias("seq")), path, 1_000_000)
    day_and_type = F.split("benchmark", "/", 2)
    return read_large_results(spark, path).select(day_and_type[0].alias("file"), day_and_type[1].alias("benchmark"), "value")


def log_lines(events: DataFrame) -> DataFrame:
    """Events as the log of one benchmark run per user: (query, seq, line)."""
    query = F.concat(F.lit("q"), col("user_id").cast("string"))
    units = hundredths("value")
    text = units.cast("string")
    tenths = F.concat_ws(
        ".", F.floor(units / 10).cast("string"), F.pmod(units, F.lit(10)).cast("string")
    )
    head = F.concat(F.lit("["), query, F.lit(" Benchmark] "))
    wallclock = F.concat(F.lit("Count=1000000 | WallClock="), tenths, F.lit(" ms | Avg UDF="), text)
    throughput = F.concat(F.lit(" ns | Throughput="), text, F.lit("000 rows/s"))
    line = (
        F.when(
            col("event_type") == "view",
            F.concat(head, wallclock, F.lit(" ns | Avg Overhead="), text, F.lit("0"), throughput),
        )
        # Clicks log no overhead, errors are warm-ups.
        .when(col("event_type") == "click", F.concat(head, wallclock, throughput))
        .when(col("event_type") == "error", F.concat(head, F.lit("WARMUP "), wallclock, throughput))
        .when(
            (col("event_type") == "purchase") & (F.pmod("user_id", F.lit(3)) > 0),
            F.concat(F.lit("[Job Summary] Job ID=7, Duration="), tenths, F.lit(" sec")),
        )
        .when(F.pmod("user_id", F.lit(5)) > 0, F.concat(F.lit("  Wall time    : "), tenths, F.lit(" s")))
        .otherwise(F.lit("plain output"))
    )
    return events.select(query.alias("query"), col("event_id").alias("seq"), line.alias("line"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as text and read back."""
    path = fresh_folder(spark, "run-log")
    write_run_log(log_lines(table(spark, sf_dir, "events")), path)
    return read_run_log(spark, path)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_metrics(log_lines(table(spark, sf_dir, "events")))


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = reports.compare_files(measurements(spark, sf_dir))
    return compared.select("file", "benchmark", F.round("ratio", 6).alias("ratio"))


def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.summarize(reports.compare_files(measurements(spark, sf_dir)))
    return summary.select("file", F.round("geomean", 6).alias("geomean"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = reports.with_units(reports.compare_files(measurements(spark, sf_dir)))
    return scaled.select("file", "benchmark", "unit", F.round("scaled", 6).alias("scaled"))


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = reports.comparison_table(measurements(spark, sf_dir))
    return cells.withColumn("value", F.round("value", 6))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table, with its first and last file as columns, and all of it in millionths as one text."""
    values, files = col("values"), F.map_keys("values")
    cell = F.transform(F.map_entries(values), lambda e: F.concat_ws(
        "=", e["key"], F.rint(e["value"] * 1_000_000).cast("long").cast("string")))
    first, last = F.element_at(files, 1), F.element_at(files, -1)
    return reports.wide_table(reports.comparison_table(measurements(spark, sf_dir))).select(
        "seq", "benchmark", "unit", F.size(values).cast("long").alias("n_files"), first.alias("first_file"),
        F.round(F.element_at(values, first), 6).alias("first_value"), last.alias("last_file"),
        F.round(F.element_at(values, last), 6).alias("last_value"), F.array_join(cell, ";").alias("cells"),
    )


def timed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = row_count(spark, sf_dir, "lineitem")
    report = reports.run_report(KERNELS["tpch_q6"](row_input(spark, sf_dir, "tpch_q6")), "tpch_q6", rows, rows)
    timed = (col("wall_s") > 0) & (col("rows_per_s") > 0)
    return report.select("tag", "input_rows", "expected_rows", "output_rows", timed.alias("timed"))


def queries() -> dict[str, Query]:
    return {
        "src_driver_tables": table_sizes,
        "src_bench_json": measured_values,
        "src_bench_json_split": measured_in_large_documents,
        "src_run_log": run_log,
        "run_report": timed_run,
        "log_metrics": metrics,
        "bench_compare": compare,
        "bench_summary": compare_summary,
        "bench_units": units,
        "bench_pivot": pivot,
        "bench_wide": wide,
    }
