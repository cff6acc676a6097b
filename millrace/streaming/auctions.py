"""Hot items and new sellers as event-time streams.

A window is final once the watermark (latest event time less the allowed delay)
has passed its end, and streams emit final windows only: what a run over the
available input returns is the batch result up to that point. With ``to_the_end`` a
closing event follows the input, so that all of its windows become final and the
result is that of the batch. Rows later than the delay would be dropped by Spark,
which is an error; choose it above the disorder of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.event_windows import hottest, utc_micros
from .runs import ClosingEvent, batches_to_tables, to_table

col = F.col
SALTS = 8


def instant(ts: Column | str) -> Column:
    """A TIMESTAMP_NTZ read as UTC, since watermarks need TIMESTAMP."""
    return F.timestamp_micros(utc_micros(col(ts) if isinstance(ts, str) else ts))


def window_counts_stream(
    events: DataFrame, key: str, ts: str, size: str, slide: str, delay: str
) -> DataFrame:
    """Final counts per hopping window and key. ``ts`` is a TIMESTAMP column.

    Rows are counted per slide-long pane; only the final counts of panes are
    copied into the windows they are part of.
    """
    panes = (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, slide).alias("pane"), key)
        .agg(F.count(F.lit(1)).alias("in_pane"))
    )
    return panes.groupBy(F.window(F.window_time("pane"), size, slide).alias("window"), key).agg(
        F.sum("in_pane").alias("num")
    )


def hot_items_stream(
    events: DataFrame,
    key: str,
    ts: str,
    size: str,
    slide: str,
    delay: str,
    origin_ms: int | None = None,
    timeout_s: float | None = None,
    to_the_end: bool = False,
) -> DataFrame:
    """(w_start, w_end, key, num) with bounds in epoch milliseconds.

    All counts of a window become final in the same micro-batch, so the batch
    operator picks the winners inside foreachBatch: the only state kept is the
    counts, and no window's keys are gathered in one place. Windows that start
    before ``origin_ms`` are left out.
    """
    closing = [ClosingEvent(events, ts)] if to_the_end else []
    counts = window_counts_stream(closing[0].after if closing else events, key, ts, size, slide, delay)

    def winners(batch: DataFrame) -> DataFrame:
        hot = hottest(batch, "window").select(
            F.unix_millis("window.start").alias("w_start"),
            F.unix_millis("window.end").alias("w_end"),
            key,
            "num",
        )
        return hot if origin_ms is None else hot.filter(col("w_start") >= origin_ms)

    return batches_to_tables(counts, "hot-items", {"winners": winners}, timeout_s, closing=closing)["winners"]


def new_sellers_stream(
    persons: DataFrame,
    auctions: DataFrame,
    size: str,
    delay: str,
    timeout_s: float | None = None,
    salts: int = SALTS,
    how: str = "inner",
) -> DataFrame:
    """Auctions opened in the window their seller registered in.

    With ``how="left"`` an auction without such a seller gives a row of NULLs: once
    the watermark has passed its window, and never before, since until then the
    seller may still register. A closing event follows both inputs then, so that the
    last windows give theirs. The salt is part of the key, so an auction meets all
    persons that could match it in the one share it is in, and gives its NULLs once.

    Input persons (p_id, name, p_ts), auctions (a_id, seller, a_ts). Both sides
    are joined on key and window, so Spark drops a window's buffered rows once
    the watermark passes its end. A stateful join is never split at run time, so
    auctions are spread over ``salts`` shares and each person is in all of them.
    """
    # The closing person has a key, the closing auction has none, so they don't match.
    closing = [ClosingEvent(persons, "p_ts", p_id=0), ClosingEvent(auctions, "a_ts")] if how == "left" else []
    if closing:
        persons, auctions = (c.after for c in closing)
    p = persons.withWatermark("p_ts", delay).select(
        "p_id", "name", F.window("p_ts", size).alias("p_window"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("p_salt"),
    )
    a = auctions.withWatermark("a_ts", delay).select(
        "a_id", "seller", F.window("a_ts", size).alias("a_window"),
        F.pmod(F.hash("a_id"), F.lit(salts)).alias("a_salt"),
    )
    same = (col("seller") == col("p_id")) & (col("a_window") == col("p_window")) & (col("a_salt") == col("p_salt"))
    joined = a.join(p, same, how)
    return to_table(
        joined.select(
            col("p_id").alias("person_id"),
            "name",
            F.unix_millis("p_window.start").alias("starttime"),
            F.when(col("p_id").isNotNull(), col("a_id")).alias("auction_id"),
        ),
        "new-sellers",
        timeout_s,
        closing=closing,
    )
