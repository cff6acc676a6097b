"""Small helpers of this subpackage: tables on the way, and streams of Arrow batches."""

from __future__ import annotations

import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.workspace import file_system, fresh_folder

#: Bytes of text or ids that a task puts into one Arrow batch.
BATCH_BYTES = 16 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: nothing above it is computed twice,
    and it outlives any executor. The folder goes when the application ends."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that is to be read from them is written itself."""
    for table in tables:
        if path := _folders.pop(table, None):
            system, target = file_system(table.sparkSession, path)
            system.delete(target, True)


def delete_at_end(spark, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def spread(rows: int, per_partition: int, least: int = 1) -> int:
    """Partitions for so many rows, so that one never holds many more than per_partition."""
    return max(least, -(-rows // per_partition))


def own_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the names the operator works with, quoted."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in wanted.items()])


#: Bits of a hash filter for each hash, and bits at the most.
BITS_EACH, MOST_BITS = 16, 1 << 26


class HashFilter:
    """Which rows of a large table may have one of some hashes: without false negatives, and with few
    false positives while there are fewer hashes than bits.

    The bits are a table of 64-bit words, so they never leave Spark. It has at most MOST_BITS / 64 rows
    of two longs, about 30 MB in memory, however many hashes there are; that is the proof for its
    broadcast. What passes still has to be joined: the filter only keeps the rest from being shuffled."""

    def __init__(self, hashes: DataFrame):
        """``hashes`` has one column of longs and should be a written table."""
        wanted = BITS_EACH * max(64, hashes.count())
        self.bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
        slots = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(self.bits)).alias("slot"))
        self.words = slots.groupBy(F.shiftright("slot", 6).alias("filter_word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("filter_bits"))

    def marked(self, rows: DataFrame, hashed: Column) -> DataFrame:
        """The rows with ``maybe``."""
        slot = rows.withColumn("filter_slot", F.pmod(hashed, F.lit(self.bits)))
        met = slot.join(F.broadcast(self.words), F.shiftright("filter_slot", 6) == F.col("filter_word"), "left")
        bit = F.expr("(shiftrightunsigned(filter_bits, CAST(filter_slot & 63 AS INT)) & 1) = 1")
        return met.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("filter_slot", "filter_word", "filter_bits")


class Rows:
    """Collects output columns and hands them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = BATCH_BYTES):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, values: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.held += size
        if self.held >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
            self.columns, self.held = [[] for _ in self.schema], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def strings(column: pa.Array) -> Iterator[str | None]:
    """Values one at a time, so that a batch is never held twice as Python strings."""
    return (value.as_py() for value in column)


def concatenated(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
