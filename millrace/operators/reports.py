"""Timing a query, and turning logs and measurements into comparison tables."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.numeric import display_unit, geometric_mean, in_unit

col = F.col

MISSING = "N/A"
SUMMARY_LABEL = "geometric mean"


def discard(df: DataFrame) -> None:
    """Compute every column of every row and write nothing."""
    df.write.format("noop").mode("overwrite").save()


def run_report(df: DataFrame, tag: str, input_rows: int, expected_rows: int = -1) -> DataFrame:
    """Run a query to the noop sink and report its wall time and throughput.

    Rows are counted in the same pass.
    """
    seen = Observation(f"rows of {tag}")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    started = time.perf_counter()
    discard(counted)
    wall = time.perf_counter() - started
    row = (tag, input_rows, expected_rows, seen.get["rows"], wall, input_rows / wall)
    return df.sparkSession.createDataFrame(
        [row],
        "tag string, input_rows long, expected_rows long, output_rows long, "
        "wall_s double, rows_per_s double",
    )


def function_overhead(
    df: DataFrame, tag: str, duration: str, further: dict[str, Column] | None = None, at_once: int | None = None
) -> DataFrame:
    """What a function costs inside a running query: one row (tag, rows, wall_s, function_s, mean_function_ns,
    mean_overhead_ns, rows_per_s, and what ``further`` aggregates).

    ``duration`` is the column of nanoseconds that each row spent in the function, null where it was not
    called. Rows, nanoseconds and further aggregates are observed in the pass that is timed, which goes to
    the noop sink: nothing is computed twice, and each task sends one row of sums.

    Overhead is the time the tasks had less the time in the function, by row: transport, the plan around
    the function, scheduling and idle slots. The tasks have as many times the wall time as run ``at_once``:
    unless told, the tasks of the last stage or the session's parallelism, whichever is less. Where one
    task runs at a time, that is the wall time less the function's time. Without rows all means are null.
    """
    further = further or {}
    seen = Observation(f"overhead of {tag}")
    task = "task of the observed pass"
    metrics = {
        "rows": F.count(F.lit(1)), "function_ns": F.coalesce(F.sum(duration), F.lit(0)).cast("long"), "last_task": F.max(f"`{task}`"), **further,
    }
    observed = df.withColumn(task, F.spark_partition_id()).observe(seen, *[c.alias(n) for n, c in metrics.items()])
    started = time.perf_counter()
    discard(observed)
    wall = time.perf_counter() - started
    found = seen.get
    rows, function_ns = found["rows"], found["function_ns"]
    if at_once is None:
        at_once = min(df.sparkSession.sparkContext.defaultParallelism, (found["last_task"] or 0) + 1)
    had_ns = wall * 1e9 * at_once
    report = df.sparkSession.createDataFrame(
        [(tag, rows, at_once, wall, function_ns / 1e9, function_ns / rows if rows else None, (had_ns - function_ns) / rows if rows else None,
          rows / wall if rows else None)],
        "tag string, rows long, at_once long, wall_s double, function_s double, mean_function_ns double, mean_overhead_ns double, rows_per_s double",
    )
    kinds = observed.select(*[c.alias(n) for n, c in further.items()]).dtypes if further else []
    return report.select("*", *[F.lit(found[n]).cast(kind).alias(n) for n, kind in kinds])


def overhead_by_batch(progress: list[dict], observation: str) -> list[dict]:
    """The same by micro-batch of a stream that observes ``rows`` and ``function_ns`` under this name: from
    the progress Spark keeps, one entry per batch that had rows. As a batch ends, its sums begin anew."""
    found = {}
    for batch in progress:
        seen = (batch.get("observedMetrics") or {}).get(observation)
        if not seen or not seen["rows"]:
            continue
        rows, wall_ns = seen["rows"], batch["durationMs"]["triggerExecution"] * 1_000_000
        function_ns = seen["function_ns"] or 0
        found[batch["batchId"]] = {
            "batch": batch["batchId"], "rows": rows, "mean_function_ns": function_ns / rows,
            "mean_overhead_ns": (wall_ns - function_ns) / rows, "rows_per_s": rows * 1e9 / max(wall_ns, 1),
        }
    return list(found.values())


def _captured(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))


def log_metrics(lines: DataFrame) -> DataFrame:
    """One row of metrics per query from its log lines (query, seq, line), also for a
    query whose log has none.

    Metrics come from the second-to-last benchmark line that is not a warm-up,
    since the last one may be cut short; from the last if there is only one.
    The duration is the last ``Duration=``, else the last ``Wall time``.
    Metrics a line lacks are "N/A".
    """
    is_metric = col("line").rlike(r"\[.*Benchmark\]") & ~col("line").contains("WARMUP")
    duration, wall = _captured(r"Duration=([0-9.]+)"), _captured(r"Wall time\s*:\s*([0-9.]+)")
    # A line once for each thing it may tell; "any" gives a query without metrics its row.
    kinds = F.array_compact(
        F.array(
            F.when(is_metric, "metric"), F.when(duration.isNotNull(), "duration"),
            F.when(wall.isNotNull(), "wall"), F.lit("any"),
        )
    )
    newest = Window.partitionBy("query", "kind").orderBy(col("seq").desc())
    # rank <= 2 is applied in every map task before the shuffle, so a long log of one query
    # reaches its final tasks as two lines of a kind per task.
    chosen = (
        lines.select("query", "seq", "line", F.explode(kinds).alias("kind"))
        .withColumn("rank", F.row_number().over(newest))
        .filter(col("rank") <= 2)
        .groupBy("query")
        .agg(
            F.max_by("line", F.when(col("kind") == "metric", col("rank"))).alias("line"),
            F.max(F.when((col("kind") == "duration") & (col("rank") == 1), duration)).alias("duration"),
            F.max(F.when((col("kind") == "wall") & (col("rank") == 1), wall)).alias("wall"),
        )
    )
    found = {
        "avg_udf_ns": _captured(r"Avg UDF=([0-9]+)"), "avg_overhead_ns": _captured(r"Avg Overhead=([0-9]+)"),
        "rows_per_s": _captured(r"Throughput=([0-9]+)"), "wallclock_ms": _captured(r"WallClock=([0-9.]+)"),
        "duration_s": F.coalesce("duration", "wall"),
    }
    return chosen.select("query", *[F.coalesce(c, F.lit(MISSING)).alias(n) for n, c in found.items()])


def compare_files(measured: DataFrame, baseline: str | None = None) -> DataFrame:
    """Mean per file and benchmark, beside the baseline file's mean.

    Input (file, benchmark, value); output (file, benchmark, mean, base_mean,
    ratio) with ratio = baseline mean / own mean, for the benchmarks that every
    file has. The baseline is the first file by name unless given.
    """
    means = measured.groupBy("file", "benchmark").agg(F.avg("value").alias("mean"))
    # One row: the means, not the measurements, tell how many files there are.
    files = means.agg(F.struct(F.count_distinct("file").alias("n"), F.min("file").alias("first"))).scalar()
    base = files["first"] if baseline is None else F.lit(baseline)
    of_benchmark = means.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("present"), F.max(F.when(col("file") == base, col("mean"))).alias("base_mean")
    )
    return (
        means.join(of_benchmark.filter(col("present") == files["n"]), "benchmark")
        .select(
            "file",
            "benchmark",
            "mean",
            "base_mean",
            (col("base_mean") / col("mean")).alias("ratio"),
        )
    )


def summarize(compared: DataFrame) -> DataFrame:
    """(file, geomean): the geometric mean of a file's ratios."""
    return compared.groupBy("file").agg(geometric_mean(col("ratio")).alias("geomean"))


def with_units(compared: DataFrame) -> DataFrame:
    """Means in the unit that suits the baseline's magnitude: adds unit and scaled."""
    return compared.withColumn("unit", display_unit(col("base_mean"))).withColumn(
        "scaled", in_unit(col("mean"), col("unit"))
    )


def comparison_table(measured: DataFrame) -> DataFrame:
    """(seq, benchmark, unit, file, value): means in display units, and the geometric means as last
    rows, which ``seq`` marks. However many files there are, each cell is a row."""
    compared = compare_files(measured)
    body = with_units(compared).select(
        F.lit(0).alias("seq"), "benchmark", "unit", "file", col("scaled").alias("value")
    )
    foot = summarize(compared).select(
        F.lit(1).alias("seq"), F.lit(SUMMARY_LABEL).alias("benchmark"), F.lit("NA").alias("unit"), "file",
        col("geomean").alias("value"),
    )
    return body.unionByName(foot)


def wide_table(cells: DataFrame) -> DataFrame:
    """The comparison table with a row per benchmark: (seq, benchmark, unit, values), where ``values`` maps
    each file to its value, in the order of the files' names. However many files there are, their names
    are data: none is known to the plan or the driver. Parts of a map are made in every task and put together."""
    entries = F.array_sort(F.collect_list(F.struct("file", "value")))
    return cells.groupBy("seq", "benchmark", "unit").agg(F.map_from_entries(entries).alias("values"))


def with_columns(wide: DataFrame, files: list[str]) -> DataFrame:
    """Columns for some of the files, cut from the map; null where a file has no value."""
    return wide.select("seq", "benchmark", "unit", *[F.try_element_at("values", F.lit(f)).alias(f) for f in files])


def side_by_side(cells: DataFrame, files: list[str]) -> DataFrame:
    """The comparison table with a column for each of the files the caller names."""
    return cells.groupBy("seq", "benchmark", "unit").pivot("file", files).agg(F.first("value"))
