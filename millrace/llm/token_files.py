"""Token ids as files: frequency-ranked, byte-aligned, with separate control bytes.

A folder holds ``ranks`` (one row per id of the corpus: rank, id, count) and
``blocks``. A block is one row of a Parquet table, so that any store Spark knows
will do: document ids, their numbers of tokens, control bytes and data bytes. A
token is written as the rank of its id, in as many bytes as the rank needs (1 to
4, low byte first); two bits in the control bytes say how many, four tokens to a
byte. Ranks below 256 - most tokens - take one byte.

Reading is a table lookup: each control byte gives, for its four tokens, the
places of 16 output bytes relative to the group's first data byte (or of a zero).

Defined cases: a null text is an empty one, which is only the end id; documents
are in ascending key order, null keys first; rows that repeat a key are ordered
by their ids; an empty table gives an empty folder with both tables; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.workspace import fresh_folder

from .encoders import byte_encoder
from .shared import Rows, delete_at_end, own_columns, spread, strings, written

END_ID = 0
#: Tokens of a block, if no single document is longer, and of a file.
BLOCK_TOKENS, FILE_TOKENS = 1 << 18, 1 << 23


def _lookup_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per control byte: bytes of each token, of the group, and the places of its 16 output bytes."""
    lengths = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1)
    first = np.cumsum(lengths, axis=1) - lengths
    byte = np.arange(4)
    places = np.where(byte < lengths[:, :, None], first[:, :, None] + byte, -1).reshape(256, 16)
    return lengths, lengths.sum(axis=1), places


LENGTHS, GROUP_BYTES, PLACES = _lookup_tables()


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned numbers below 2**32."""
    values = values.astype(np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-len(values) % 4 + len(values), np.uint8)
    padded[:len(values)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    codes = np.frombuffer(control, np.uint8)
    # The last group's missing tokens count as one byte each, past the data.
    room = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    start = np.cumsum(GROUP_BYTES[codes]) - GROUP_BYTES[codes]
    places = PLACES[codes]
    at = np.where(places < 0, len(room) - 1, np.minimum(start[:, None] + places, len(room) - 1))
    return room[at].view("<u4").reshape(-1)[:count]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])


def _encode(vocabulary: str, end_id: int, width: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = byte_encoder(vocabulary), Rows(ENCODED)
        for batch in batches:
            for key, text in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
                ids = np.append(coder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                stored = ids.astype(width).tobytes()
                yield from out.add((key, len(ids), zlib.crc32(ids), stored), len(stored))
        yield from out.rest()

    return run


COUNTED = pa.schema([("id", pa.int64()), ("n", pa.int64())])


def _count(width: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in strings(batch.column(0)):
                more = np.bincount(np.frombuffer(ids, width))
                if len(more) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(more) - len(counts), np.int64)])
                counts[:len(more)] += more
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], schema=COUNTED)

    return run


BLOCKS = pa.schema([
    ("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()),
])


def _blocks(rank_of: np.ndarray, width: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, out = TaskContext.get().partitionId(), 0, Rows(BLOCKS)
        keys, held, size = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(held)
            control, data = pack(rank_of[ids])
            yield from out.add((part, block, len(ids), keys, [len(x) for x in held], control, data), len(data))

        for batch in batches:
            for key, ids in zip(strings(batch.column("doc_id")), strings(batch.column("ids")), strict=True):
                held.append(np.frombuffer(ids, width))
                keys.append(key)
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield from close()
                    keys, held, size, block = [], [], 0, block + 1
        if keys:
            yield from close()
        yield from out.rest()

    return run


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> None:
    """Encode every whole text, and write the folder at ``path``."""
    width = "<u2" if max(byte_encoder(vocabulary).library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    encoded = written(
        own_columns(docs, doc_id=key, text=text).mapInArrow(_encode(vocabulary, end_id, width), "doc_id long, n long, crc long, ids binary"),
        "encoded",
    )
    counts = encoded.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("count"))
    ranks = counts.select(  # no more rows than the vocabulary has
        (F.row_number().over(Window.orderBy(F.desc("count"), "id")) - 1).cast("long").alias("rank"), "id", "count"
    )
    ranks.write.parquet(f"{path}/ranks")
    table = encoded.sparkSession.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    rank_of = np.zeros(1 + max([r["id"] for r in table], default=0), np.uint32)
    rank_of[[r["id"] for r in table]] = np.arange(len(table))
    files = spread(encoded.agg(F.sum("n")).first()[0] or 0, FILE_TOKENS)
    ordered = encoded.repartitionByRange(files, "doc_id", "n", "crc").sortWithinPartitions("doc_id", "n", "crc", "ids")
    ordered.select("doc_id", "ids").mapInArrow(
        _blocks(rank_of, width),
        "part long, block long, n long, doc_ids array<long>, lengths array<long>, control binary, data binary",
    ).write.option("compression", "zstd").parquet(f"{path}/blocks")


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _documents(id_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(DOCUMENTS)
        for batch in batches:
            for n, first, keys, lengths, control, data in zip(*(strings(batch.column(c)) for c in range(6)), strict=True):
                ids = id_of[unpack(control, data, n)]
                at = 0
                for key, length in zip(keys, lengths, strict=True):
                    yield from out.add((key, first + at, length, ids[at:at + length].tobytes()), 4 * length)
                    at += length
        yield from out.rest()

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): per document the ids of all documents before it, and its own
    with the end id, as little-endian unsigned 32-bit integers."""
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in table], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    starts = sizes.select("part", "block", inside.alias("inside")).join(parts, "part").select(
        "part", "block", (F.col("before") + F.col("inside")).alias("first")
    )
    return blocks.join(starts, ["part", "block"]).select("n", "first", "doc_ids", "lengths", "control", "data").mapInArrow(
        _documents(id_of), "doc_id long, start long, n_tokens long, ids binary"
    )


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Written, read back, and summed up per document."""
    spark = docs.sparkSession
    path = fresh_folder(spark, "token-files")
    write_token_files(docs, vocabulary, path)
    delete_at_end(spark, path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
