"""Auction-stream queries 3, 5 and 8, and the same shapes on the event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.event_windows import (
    hot_items,
    label_hot_rows,
    match_in_window,
    window_start,
)
from ..operators.row_kernels import overhead
from ..sources.tables import table
from . import auction_inputs as given
from .row_inputs import tasks_of_lines

col = F.col
Query = Callable[[SparkSession, str], DataFrame]

# FIXED VALUES
TARGET_CATEGORY = 10
TARGET_STATES = ["OR", "ID", "CA"]
# The workload's seconds are days here, as the given tables know no shorter times.
HOP_SIZE, HOP_SLIDE = "10 days", "2 days"
TUMBLE = "10 days"
EVENT_HOP_SIZE, EVENT_HOP_SLIDE = "2 hours", "30 minutes"
EVENT_TUMBLE = "6 hours"


def local_sellers(
    auctions: DataFrame, persons: DataFrame, keep_unmatched: bool = False
) -> DataFrame:
    """Query 3: auctions of one category by sellers in three states.

    With ``keep_unmatched`` every auction gives a row, of NULLs when it does not
    qualify. Auctions of other categories cannot match, so they skip the join
    (and its shuffle) and are appended as NULL rows.
    """
    wanted = col("category") == TARGET_CATEGORY
    sellers = persons.filter(col("state").isin(TARGET_STATES)).select(
        "p_id", "name", "city", "state"
    )
    matched = auctions.filter(wanted).join(
        sellers, col("seller") == col("p_id"), "left" if keep_unmatched else "inner"
    )
    found = matched.select(
        "name", "city", "state", F.when(col("p_id").isNotNull(), col("a_id")).alias("auction_id")
    )
    if not keep_unmatched:
        return found.select("*", overhead())
    others = auctions.filter(~F.coalesce(wanted, F.lit(False))).select(
        *[F.lit(None).cast("string").alias(c) for c in ("name", "city", "state")],
        F.lit(None).cast("long").alias("auction_id"),
    )
    return found.unionAll(others).select("*", overhead())


def hot_bids(bids: DataFrame, size: str = HOP_SIZE, slide: str = HOP_SLIDE, tasks: int | None = None) -> DataFrame:
    """Query 5 per bid: the auction and its best winning count, NULLs when it never won."""
    timed = bids.select("auction", F.timestamp_millis("date_time").alias("ts"))
    return label_hot_rows(timed, "auction", "ts", size, slide, tasks=tasks).select(
        "auction", "num", overhead()
    )


def hot_auctions(bids: DataFrame, size: str = HOP_SIZE, slide: str = HOP_SLIDE, tasks: int | None = None) -> DataFrame:
    """Query 5 as (window, auction, count), window bounds in epoch milliseconds."""
    timed = bids.select("auction", F.timestamp_millis("date_time").alias("ts"))
    return hot_items(timed, "auction", "ts", size, slide, tasks=tasks).select(
        F.unix_millis("w_start").alias("w_start"),
        F.unix_millis("w_end").alias("w_end"),
        "auction",
        "num",
    )


def new_sellers(
    auctions: DataFrame, persons: DataFrame, how: str = "inner", window: str = TUMBLE
) -> DataFrame:
    """Query 8: persons who open an auction in the window in which they registered."""
    a = auctions.select("a_id", "seller", F.timestamp_millis("a_date_time").alias("a_ts"))
    p = persons.select("p_id", "name", F.timestamp_millis("p_date_time").alias("p_ts"))
    return match_in_window(a, p, "seller", "p_id", "a_ts", "p_ts", window, how).select(
        col("p_id").alias("person_id"),
        "name",
        F.unix_millis("w_start").alias("starttime"),
        F.when(col("p_id").isNotNull(), col("a_id")).alias("auction_id"),
        overhead(),
    )


def active_new_persons(auctions: DataFrame, persons: DataFrame) -> DataFrame:
    """The existence half of query 8: persons with any auction in their window."""
    p = persons.select("p_id", "name", F.timestamp_millis("p_date_time").alias("p_ts"))
    # One row per seller and window: a busy seller must not pile up in one join task.
    a = (
        auctions.select("seller", F.timestamp_millis("a_date_time").alias("a_ts"))
        .groupBy("seller", window_start("a_ts", TUMBLE).alias("a_start"))
        .agg(F.count(F.lit(1)).alias("opened"))
    )
    placed = p.withColumn("w_start", window_start("p_ts", TUMBLE))
    on = (col("p_id") == col("seller")) & (col("w_start") == col("a_start"))
    return placed.join(a, on, "left_semi").select(
        col("p_id").alias("person_id"), "name", F.unix_millis("w_start").alias("starttime")
    )


def hot_event_types(events: DataFrame) -> DataFrame:
    return hot_items(
        events.select("event_type", "ts"), "event_type", "ts", EVENT_HOP_SIZE, EVENT_HOP_SLIDE
    )


def first_signups(events: DataFrame, size: str = EVENT_TUMBLE) -> DataFrame:
    """The first signup of each user in each window."""
    return (
        events.filter(col("event_type") == "signup")
        .groupBy(col("user_id").alias("new_user"), window_start("ts", size).alias("w"))
        .agg(F.min("ts").alias("signup_ts"))
        .drop("w")
    )


def new_user_purchases(events: DataFrame) -> DataFrame:
    """Purchases in the window of the buyer's signup; at most one row per purchase."""
    purchases = events.filter(col("event_type") == "purchase").select("event_id", "user_id", "ts")
    return match_in_window(
        purchases, first_signups(events), "user_id", "new_user", "ts", "signup_ts", EVENT_TUMBLE
    ).select("user_id", "w_start", "signup_ts", "event_id")


def persons_and_auctions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return given.persons(spark, sf_dir), given.auctions(spark, sf_dir)


def queries() -> dict[str, Query]:
    def with_both(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            persons, auctions = persons_and_auctions(spark, sf_dir)
            return plan(auctions, persons)

        return query

    def with_bids(plan: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: plan(given.bids(spark, sf_dir), tasks=tasks_of_lines(spark, sf_dir))

    def with_events(plan: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: plan(table(spark, sf_dir, "events"))

    return {
        "nexmark_q3": with_both(lambda a, p: local_sellers(a, p, keep_unmatched=True)),
        "nexmark_q3_matches": with_both(local_sellers),
        "nexmark_q5": with_bids(hot_bids),
        "nexmark_q5_hot_items": with_bids(hot_auctions),
        "nexmark_q8": with_both(lambda a, p: new_sellers(a, p, "left")),
        "nexmark_q8_matches": with_both(new_sellers),
        "nexmark_q8_active": with_both(active_new_persons),
        "ev_hot_types": with_events(hot_event_types),
        "ev_new_user_buyers": with_events(new_user_purchases),
    }
