"""Running a stream over what is there now, into tables.

Streams write to the file sink or through foreachBatch into folders keyed by
batch, never to the memory sink: results must not pass through the driver, and
a restarted batch must replace its own output. State size and the state store
are the session's choice (``spark.sql.streaming.stateStore.providerClass``;
RocksDB for large state). A micro-batch reads at most BATCH_BYTES.

Rows behind the watermark would be missing from the result, so a stream that drops
any is an error. ``disorder`` tells the delay that a table of files needs.

A watermark never passes the last windows of an input that ends. ``ClosingEvent`` holds
an event back that is later than any other, and lets it in once all else is read: the
stream is then run on, from its checkpoint, and ends its windows itself.

A caller that names the folder can run the same stream again: it goes on after
the last batch that was finished. Without a name, the folder is the run's own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..sources.workspace import file_system, fresh_folder

#: Input of a micro-batch, if no single file is larger.
BATCH_BYTES = 4 << 30


#: Seconds between looks at a running stream.
POLL_S = 5


def _dropped(query: StreamingQuery) -> dict[int, int]:
    """Rows dropped behind the watermark, by batch."""
    found: dict[int, int] = {}
    for p in query.recentProgress:
        late = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
        found[p["batchId"]] = max(late, found.get(p["batchId"], 0))
    return found


#: Later than any event, and early enough for windows and delays to stay within a timestamp.
CLOSING_TIME = datetime(9000, 1, 1)


class ClosingEvent:
    """An event after all others, as a source of its own that is empty until ``let_in``.

    Its columns are null but for the time and ``values``, and its own window stays open. The key of a
    join's side that drops null keys needs a value: the filter for it comes before the watermark.
    """

    def __init__(self, stream: DataFrame, ts: str, **values):
        self.spark, self.schema, self.values = stream.sparkSession, stream.schema, {**values, ts: CLOSING_TIME}
        self.path = fresh_folder(self.spark, "closing-event")
        system, path = file_system(self.spark, self.path)
        system.mkdirs(path)
        nullable = StructType([StructField(f.name, f.dataType) for f in self.schema])
        self.after = stream.unionByName(self.spark.readStream.schema(nullable).parquet(self.path))

    def let_in(self) -> None:
        columns = [F.lit(self.values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).coalesce(1).select(*columns).write.mode("append").parquet(self.path)


def finish(
    writer: DataStreamWriter, checkpoint: str, timeout_s: float | None = None, closing: Sequence[ClosingEvent] = (),
    watch: Callable[[list], None] | None = None,
) -> None:
    """Start a stream, process all available input, let its closing events in and process them, stop.
    Failures are raised, and dropped rows are one. ``watch`` is handed the latest progresses again and again."""
    _drain(writer, checkpoint, timeout_s, watch)
    if closing:
        for event in closing:
            event.let_in()
        _drain(writer, checkpoint, timeout_s, watch)


def _drain(writer: DataStreamWriter, checkpoint: str, timeout_s: float | None, watch: Callable[[list], None] | None) -> None:
    watch = watch or (lambda progress: None)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        # awaitTermination raises the stream's own error if it failed.
        end, dropped = None if timeout_s is None else time.monotonic() + timeout_s, {}
        while not query.awaitTermination(POLL_S):
            dropped |= _dropped(query)  # only the last progresses are kept
            watch(query.recentProgress)
            if end is not None and time.monotonic() > end:
                raise TimeoutError(f"stream did not finish in {timeout_s} s")
        dropped |= _dropped(query)
        watch(query.recentProgress)
        if late := sum(dropped.values()):
            raise RuntimeError(f"{late} rows came later than the stream's delay and were dropped; choose a longer one")
    finally:
        query.stop()


def to_table(
    stream: DataFrame, name: str, timeout_s: float | None = None, folder: str | None = None, closing: Sequence[ClosingEvent] = ()
) -> DataFrame:
    """Append a stream's rows to a parquet table and return that table."""
    spark = stream.sparkSession
    base = folder or fresh_folder(spark, name)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows")
    finish(writer, f"{base}/checkpoint", timeout_s, closing)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def discard(stream: DataFrame, timeout_s: float | None = None) -> None:
    """Compute a stream in full and keep nothing: for load and timing."""
    checkpoint = fresh_folder(stream.sparkSession, "discarded")
    finish(stream.writeStream.format("noop"), checkpoint, timeout_s)


def print_stream(stream: DataFrame, rows: int = 2**31 - 1, timeout_s: float | None = None) -> None:
    """Print every micro-batch: all of its rows, unless told how many."""
    checkpoint = fresh_folder(stream.sparkSession, "printed")
    finish(stream.writeStream.format("console").option("numRows", rows), checkpoint, timeout_s)


def batches_to_tables(
    stream: DataFrame,
    name: str,
    outputs: dict[str, Callable[[DataFrame], DataFrame]],
    timeout_s: float | None = None,
    folder: str | None = None,
    closing: Sequence[ClosingEvent] = (),
) -> dict[str, DataFrame]:
    """Several sinks fed from one pass: each micro-batch goes through every transform.

    The micro-batch is persisted while its outputs are written, so the source
    is read, and state is updated, once. Each output of a batch has a folder of
    its own that a retry overwrites. A stream without rows gives empty tables.
    """
    spark = stream.sparkSession
    base = folder or fresh_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for output, transform in outputs.items():
                transform(batch).write.mode("overwrite").parquet(f"{base}/{output}/batch-{batch_id}")
        finally:
            batch.unpersist()

    finish(stream.writeStream.outputMode("append").foreachBatch(write), f"{base}/checkpoint", timeout_s, closing)
    tables = {}
    for output, transform in outputs.items():
        system, path = file_system(spark, f"{base}/{output}")
        system.mkdirs(path)
        rows = spark.createDataFrame([], stream.schema)
        read = spark.read.schema(transform(rows).schema).option("recursiveFileLookup", "true")
        tables[output] = read.parquet(f"{base}/{output}")
    return tables


def table_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A parquet table as a stream of its files: a folder, partitioned or not, or a single file."""
    system, target = file_system(spark, path)
    if not system.exists(target):
        raise FileNotFoundError(f"no table at {path}")
    if not system.getFileStatus(target).isDirectory():
        # The file source takes folders and patterns: this pattern matches the one file.
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    return reader.load(path)


def disorder(rows: DataFrame, ts: str) -> int:
    """Microseconds by which a table's file may lie behind what files read before it hold, wherever
    micro-batches are cut: files are streamed in the order of their modification, equal ones in any."""
    files = rows.select("_metadata.file_path", F.col("_metadata.file_modification_time").alias("at"), ts).groupBy("file_path", "at").agg(
        *[F.unix_micros(x(F.col(ts)).cast("timestamp_ntz").cast("timestamp")).alias(n) for n, x in (("low", F.min), ("high", F.max))])
    together = files.groupBy("at").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    before = F.max("high").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # a row per time of modification
    behind = F.greatest(before, F.when(F.col("n") > 1, F.col("high"))) - F.col("low")
    return max(together.select(behind.alias("behind")).agg(F.max("behind")).first()[0] or 0, 0)


def as_stream(
    df: DataFrame, closing: DataFrame | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Write rows to the shared folder and open them as a stream.

    ``closing`` is appended last: an event long after all others, which lets
    the watermark pass the final windows.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "stream-input")
    df.write.parquet(path)
    if closing is not None:
        closing.write.mode("append").parquet(path)
    return table_stream(spark, path, df.schema, files_per_trigger=files_per_trigger)


def given_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return table_stream(spark, path, spark.read.parquet(path).schema)
