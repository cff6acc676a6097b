"""Best-fit packing by hierarchical residual packing.

Documents become token sequences with an end id; those over the capacity are cut
so that only the first piece is short. Full pieces are sequences of their own.
All other pieces are items: each partition packs its items best-fit, longest
first, and emits the nearly full bins. Underfull bins become the items of the
next round, in fewer partitions, until one partition is left or a round has
stopped saving bins. A partition never holds more than ITEMS_PER_TASK bins, and a
bin never more items than the capacity has tokens.

Defined cases: a null text is an empty one (one piece, the end id alone); rows
that repeat a key are packed each on its own; null keys are kept; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import byte_encoder
from .shared import Rows, own_columns, spread, strings, written

CAPACITY, END_ID = 1024, 2
ITEMS_PER_TASK = 20_000
#: A bin this close to full, as a share of the capacity, is emitted without waiting for more.
NEARLY = 1 / 256
#: A further round is run if the last one saved this share of its bins.
WORTH = 1 / 500


def pieces_schema(with_ids: bool) -> pa.Schema:
    return pa.schema([
        ("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else []),
    ])


def _pieces(vocabulary: str, capacity: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = byte_encoder(vocabulary), Rows(pieces_schema(with_ids))
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for key, text in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
                ids = np.append(coder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                for piece, (start, end) in enumerate(zip([0, *ends], ends)):
                    part = ids[start:end]
                    row = (uid, key, piece, start, end - start, zlib.crc32(part))
                    yield from out.add((*row, part.tobytes()) if with_ids else row, 64 + 4 * len(part) * with_ids)
                    uid += 1
        yield from out.rest()

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]) of whole texts. ``uid`` numbers the
    pieces; it is stable once the result is written."""
    columns = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return own_columns(docs, doc_id=key, text=text).mapInArrow(_pieces(vocabulary, capacity, end_id, with_ids), columns)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of ``sizes`` in bins, taken in the given order: each goes to the fullest bin that has
    room. Bins are kept by the room they have left, and a bit set names the rooms in use."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    for item, size in enumerate(sizes):
        fitting = in_use >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                in_use &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        left = room - size
        if left:
            by_room[left].append(at)
            in_use |= 1 << left
    return bins


BINS = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
BIN_COLUMNS = "bin long, fill int, members array<long>, lengths array<int>"


def _pack(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The order of arrival has no effect: a task that is run again packs the same bins.
        items = sorted((row for b in batches for row in zip(*(strings(b.column(c)) for c in range(4)), strict=True)),
                       key=lambda row: (-row[1], row[0]))
        out = Rows(BINS)
        for found in best_fit([row[1] for row in items], capacity):
            members = [uid for i in found for uid in items[i][2]]
            lengths = [n for i in found for n in items[i][3]]
            yield from out.add((min(items[i][0] for i in found), sum(lengths), members, lengths), 16 * len(members))
        yield from out.rest()

    return run


def packed(items: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(uid, sequence_id, offset) for every (uid, length), where lengths are 1 to the capacity. A
    sequence's id is the smallest uid in it. ``items`` has to be stable, as a written table is."""
    full = items.filter(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bins = items.filter(F.col("length") < capacity).select(
        F.col("uid").alias("bin"), F.col("length").cast("int").alias("fill"),
        F.array("uid").alias("members"), F.array(F.col("length").cast("int")).alias("lengths"),
    )
    count, done, step = bins.count(), [], 0
    partitions = spread(count, items_per_task)
    while count:
        dealt = bins.repartition(partitions, F.xxhash64("bin", F.lit(step)))
        bins = written(dealt.mapInArrow(_pack(capacity), BIN_COLUMNS), "bins")
        nearly = F.col("fill") >= capacity - int(capacity * NEARLY)
        done.append(bins.filter(nearly))
        made, open_bins = bins.count(), bins.filter(~nearly)
        left = open_bins.count()
        if partitions == 1 or count - made < WORTH * count:
            done.append(open_bins)
            break
        bins, count, step = open_bins, left, step + 1
        partitions = max(spread(left, items_per_task), partitions // 8)
    placed = full
    for part in done:
        offsets = F.transform("lengths", lambda n, i: F.lit(0).cast("long") + F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
        member = part.select("bin", F.explode(F.arrays_zip(F.col("members").alias("uid"), offsets.alias("offset"))).alias("m"))
        placed = placed.unionByName(member.select("m.uid", F.col("bin").alias("sequence_id"), "m.offset"))
    return placed


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, **columns: str) -> DataFrame:
    """Every piece with its place: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    table = written(pieces(docs, vocabulary, capacity, end_id, with_ids=with_ids, **columns), "pieces")
    return table.join(packed(table.select("uid", "length"), capacity), "uid").drop("uid")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed token sequences themselves, none over the capacity."""
    part = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return placed.groupBy("sequence_id").agg(part.alias("parts"), F.sum("length").alias("length")).select(
        "sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids")
    )


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack_documents(docs, vocabulary, with_ids=False)
