"""Sharding by proportional stratified interleaving.

Rows are put into a seeded random order within their source and given the
fraction of the source that lies before them. Sorted by that fraction, every
stretch holds the sources in the proportions of the whole, so equal cuts give
shards that match the mixture, with counts at most one apart.

No source, however large, is ranked in one task: a row's rank is the number of
rows in the lower hash ranges of its source, which are counted first, plus its
place in its own range. The hash is of the whole row. Rows that are equal in all
columns share it, so a range that they fill is divided once more, by where a row
stands in a table written before; which of equal rows gets which slot is without
effect. The global order is ranked in the same way, by ranges of the fraction. What
is ranked in one task are ranges, of which there is one for ROWS_PER_RANGE rows.

Defined cases: rows with a null source are a source of their own; rows with a
null key are placed like others; repeated rows each get a slot, and which of two
wholly equal rows gets which slot is without effect; an empty table gives no
rows; further columns are carried along, whatever their names (those of the
result, ``shard`` and ``slot``, are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import spread, written

SHARDS, SEED = 24, 20_240_229
#: Rows ranked together in one window.
ROWS_PER_RANGE = 10_000


def interleaved(
    df: DataFrame, shards: int = SHARDS, strata: str = "source", key: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard)."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    inner = [f"c{n}" for n in range(len(names))]
    own = dict(zip(names, inner, strict=True))
    plain = df.select(*[F.col(f"`{n}`").alias(c) for n, c in own.items()])
    further = [F.col(c) for c, t in plain.dtypes if c != own[key] and not t.startswith(("map", "variant"))]
    rows = written(plain.withColumn("h", F.xxhash64(F.lit(seed), F.col(own[key]), *further)), "interleaved")
    # A written table's rows stay where they are: file and row number tell equal rows apart.
    stands = F.xxhash64(F.lit(seed), F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), "_metadata.row_index")
    rows = rows.withColumn("stands", stands)
    total = rows.count()
    ranges = spread(total, ROWS_PER_RANGE)
    source = own[strata]
    # Not all types can be ordered; their rows are then told apart by where they stand.
    ties = [F.col(c) for c, t in rows.dtypes if c in inner and not t.startswith(("map", "variant"))]

    # 1. Rank within the source: rows of lower hash ranges, then the place in the own range.
    cell = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges)
    rows = rows.withColumn("cell", F.least(cell, F.lit(ranges - 1)))
    full = rows.groupBy(F.col(source).alias("full_source"), F.col("cell").alias("full_cell")).agg(F.count("*").alias("n"))
    full = full.filter(F.col("n") > 4 * ROWS_PER_RANGE).select("full_source", "full_cell", F.ceil(F.col("n") / ROWS_PER_RANGE).alias("parts"))
    rows = rows.join(full, F.col(source).eqNullSafe(F.col("full_source")) & (F.col("cell") == F.col("full_cell")), "left").withColumn(
        "part_of_cell", F.pmod("stands", F.coalesce("parts", F.lit(1))))
    by_source = Window.partitionBy(source)
    cells = (
        rows.groupBy(source, "cell", "part_of_cell").agg(F.count("*").alias("n"))
        .withColumn("of", F.sum("n").over(by_source))
        .withColumn("before", F.sum("n").over(by_source.orderBy("cell", "part_of_cell")) - F.col("n"))
        .select(F.col(source).alias("of_source"), F.col("cell").alias("of_cell"), F.col("part_of_cell").alias("of_part"), "of", "before")
    )
    place = F.row_number().over(Window.partitionBy(source, "cell", "part_of_cell").orderBy("h", *ties, "stands"))
    ranked = rows.withColumn("place", place).join(
        cells, F.col(source).eqNullSafe(F.col("of_source")) & (F.col("cell") == F.col("of_cell")) & (F.col("part_of_cell") == F.col("of_part"))
    ).withColumn("part", (F.col("before") + F.col("place") - 0.5) / F.col("of"))

    # 2. Rank by the fraction over all sources, again by ranges.
    ranked = ranked.select(*inner, "h", "stands", "part", F.least(F.floor(F.col("part") * ranges), F.lit(ranges - 1)).alias("span"))
    ranked = written(ranked, "interleaved")
    spans = ranked.groupBy("span").agg(F.count("*").alias("n"))
    spans = spans.select(  # as many rows as there are ranges
        F.col("span").alias("of_span"), (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("span").orderBy("part", "h", *ties, "stands")) - 1
    placed = ranked.withColumn("place", place).join(spans, F.col("span") == F.col("of_span"))
    position = F.col("before") + F.col("place")

    # 3. Cut.
    shard = F.floor(position * shards / F.lit(max(total, 1))) if total * shards < 2**52 else F.expr(
        f"(before + place) * {shards}L div {total}L")
    placed = placed.select(*inner, position.alias("position"), shard.cast("int").alias("shard"))
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards)) if total * shards < 2**52 else F.expr(
        f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(
        *[F.col(c).alias(n) for n, c in own.items()], "shard", (F.col("position") - first).cast("long").alias("slot")
    )


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard, rows in the order of their slots; a shard may be cut into several files."""
    shards = placed.agg(F.max("shard")).first()[0]
    placed.repartitionByRange(((shards or 0) + 1) * files_per_shard, "shard", "slot").sortWithinPartitions(
        "shard", "slot"
    ).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """Rows of all documents with their shard; law ``rows``: counts are at most one apart."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    narrow = docs.select(
        F.col("`doc_id`").alias("doc_id"), F.col("`source`").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleaved(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )
