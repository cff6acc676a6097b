"""Benchmark-result documents: JSON with runs of measured values, nested twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

col = F.col

_NAME = "struct<name: string>"
_RUNS = f"array<struct<metadata: {_NAME}, values: array<double>>>"
SCHEMA = (
    f"benchmarks array<struct<metadata: {_NAME}, runs: {_RUNS}>>, "
    f"runs {_RUNS}, metadata {_NAME}"
)


def read_bench_results(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, file_column: str | None = None
) -> DataFrame:
    """(file, benchmark, value), one row per measured value.

    A document holds either a list of benchmarks or the runs of a single one. A
    benchmark is named by its own metadata, else by its first run that has a
    name, else by the document. A list entry without any name is skipped; a
    lone benchmark without one is called "unknown".

    With ``multi_line`` each file is one document; without, each line is one,
    which lets Spark split large files. ``file`` is the file's name, or a
    partition column if ``file_column`` names it.
    """
    schema = SCHEMA if file_column is None else f"{SCHEMA}, {file_column} string"
    documents = spark.read.schema(schema).json(path, multiLine=multi_line)
    file = col("_metadata.file_name") if file_column is None else col(file_column)
    is_list = col("benchmarks").isNotNull()
    single = F.array(F.struct(col("metadata").alias("metadata"), col("runs").alias("runs")))
    entries = documents.select(
        file.alias("file"),
        is_list.alias("listed"),
        col("metadata.name").alias("document_name"),
        F.explode(F.when(is_list, col("benchmarks")).otherwise(single)).alias("entry"),
    )
    run_names = F.filter(
        F.transform("entry.runs", lambda run: run["metadata"]["name"]), lambda n: n.isNotNull()
    )
    fallback = F.when(~col("listed"), F.lit("unknown"))
    named = entries.select(
        "file",
        F.coalesce(
            col("entry.metadata.name"), F.get(run_names, F.lit(0)), col("document_name"), fallback
        ).alias("benchmark"),
        F.explode("entry.runs").alias("run"),
    )
    return named.filter(col("benchmark").isNotNull()).select(
        "file", "benchmark", F.explode("run.values").alias("value")
    )


def write_result_lines(measured: DataFrame, path: str) -> None:
    """Write (file, benchmark, value, seq) as one document per line, partitioned by file.

    The four places a name can live in take turns by ``seq``. Rows are
    rebalanced first, so a file's folder gets few large parts, and a file that
    holds most of the rows gets several.
    """
    name = F.struct(col("benchmark").alias("name"))
    no_name = F.lit(None).cast(_NAME)
    values = F.array("value").alias("values")
    place = F.pmod("seq", F.lit(4))

    def runs(metadata):
        return F.array(F.struct(metadata.alias("metadata"), values))

    def benchmarks(own, in_run):
        return F.array(F.struct(own.alias("metadata"), runs(in_run).alias("runs")))

    measured.select(
        "file",
        F.when(place == 0, benchmarks(name, no_name))
        .when(place == 1, benchmarks(no_name, name))
        .when(place == 2, benchmarks(no_name, no_name))
        .alias("benchmarks"),
        F.when(place == 3, runs(no_name)).alias("runs"),
        F.when(place >= 2, name).alias("metadata"),
    ).hint("rebalance", "file").write.partitionBy("file").json(path)
