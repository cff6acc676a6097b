"""Streaming queries: the given tables, or tables Spark derives from them, as file streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.event_windows import micros, utc_micros
from ..operators.row_kernels import overhead
from ..sources.tables import table
from ..streaming import auctions, prices
from ..streaming.runs import batches_to_tables, disorder, given_table_stream, to_table
from .nexmark import EVENT_HOP_SIZE, EVENT_HOP_SLIDE, EVENT_TUMBLE

col = F.col
Query = Callable[[SparkSession, str], DataFrame]

#: The least delay of event streams. A table in more disorder gets what it needs.
EVENT_DELAY = "1 hour"
AUCTIONS = 100


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as (id, price, quantity)."""
    return given_table_stream(spark, sf_dir, "events").select(
        col("event_id").alias("id"),
        col("value").alias("price"),
        (F.pmod("user_id", F.lit(10)) + 1).cast("int").alias("quantity"),
    )


def datagen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(event_prices(spark, sf_dir), "prices")


def price_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(prices.stepped(event_prices(spark, sf_dir)), "stepped").select("id", "price")


def price_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(prices.stepped_natively(event_prices(spark, sf_dir)), "stepped-natively")


def vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = given_table_stream(spark, sf_dir, "lineitem").select(
        col("l_orderkey").alias("id"),
        col("l_extendedprice").alias("price"),
        col("l_quantity").alias("quantity"),
    )
    return to_table(prices.valued(lines), "valued").select("id", F.round("value", 3).alias("value"))


def statement_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sinks fed by one pass over the stream, read back with the sink's name."""
    sinks = batches_to_tables(
        event_prices(spark, sf_dir),
        "statement-set",
        {"stepped": prices.stepped_natively, "valued": prices.valued},
    )
    stepped = sinks["stepped"].select(F.lit("stepped").alias("sink"), "id", col("price").alias("value"))
    valued = sinks["valued"].select(F.lit("valued").alias("sink"), "id", "value")
    return stepped.unionByName(valued).withColumn("value", F.round("value", 3))


def event_delay(spark: SparkSession, sf_dir: str) -> str:
    """A delay with which no event is late."""
    needed = disorder(table(spark, sf_dir, "events"), "ts")
    return EVENT_DELAY if needed < micros(EVENT_DELAY) else f"{needed // 1_000_000 + 1} seconds"


def hot_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bids on a hundred auctions."""
    auction = F.pmod("user_id", F.lit(AUCTIONS)).alias("auction")
    bids = given_table_stream(spark, sf_dir, "events").select(auction, auctions.instant("ts").alias("ts"))
    rows = table(spark, sf_dir, "events").select(auction, "ts")
    return all_windows(bids, rows, "auction", EVENT_HOP_SIZE, EVENT_HOP_SLIDE, event_delay(spark, sf_dir))


def new_sellers(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Signups as persons, purchases as the auctions they open."""
    signups = given_table_stream(spark, sf_dir, "events").filter(col("event_type") == "signup").select(
        col("user_id").alias("p_id"), F.concat(F.lit("user_"), col("user_id").cast("string")).alias("name"),
        auctions.instant("ts").alias("p_ts"))
    purchases = given_table_stream(spark, sf_dir, "events").filter(col("event_type") == "purchase").select(
        col("event_id").alias("a_id"), col("user_id").alias("seller"), auctions.instant("ts").alias("a_ts"))
    matches = auctions.new_sellers_stream(signups, purchases, EVENT_TUMBLE, event_delay(spark, sf_dir), how=how)
    return matches.select("*", overhead())


def all_windows(
    stream: DataFrame, rows: DataFrame, key: str, size: str, slide: str, delay: str
) -> DataFrame:
    """Hot items of every window, all from the stream. Of ``rows``, the same events as a table, only the
    first time is read: windows begin with its slide."""
    first = rows.agg(F.min("ts").alias("ts")).select(utc_micros(col("ts").cast("timestamp_ntz"))).first()[0] or 0
    origin = first // micros(slide) * micros(slide)
    return auctions.hot_items_stream(stream, key, "ts", size, slide, delay, origin_ms=origin // 1000, to_the_end=True)


def hot_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = given_table_stream(spark, sf_dir, "events").select(
        "event_type", auctions.instant("ts").alias("ts")
    )
    rows = table(spark, sf_dir, "events").select("event_type", "ts")
    return all_windows(events, rows, "event_type", EVENT_HOP_SIZE, EVENT_HOP_SLIDE, event_delay(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "src_stream_datagen": datagen,
        "stream_price_lateral": price_lateral,
        "stream_price_native": price_native,
        "stream_vectorised_calc": vectorised,
        "stream_statement_set": statement_set,
        "stream_nexmark_q5": hot_auctions,
        "stream_nexmark_q8": new_sellers,
        "stream_nexmark_q8_outer": partial(new_sellers, how="left"),
        "stream_ev_hot_types": hot_event_types,
    }
