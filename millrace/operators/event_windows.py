"""Event-time windows over auctions and events: hot items and same-window matches.

Times are TIMESTAMP or TIMESTAMP_NTZ columns; results keep the type. Windows
are aligned to the epoch by ``F.window``, which does not look at the session's
time zone, and are half-open, [start, end).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col

_ORIGIN = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(width: str) -> int:
    return pd.Timedelta(width).value // 1000


def interval(width: str) -> Column:
    return F.expr(f"INTERVAL {width}")


def utc_micros(ts: Column) -> Column:
    """A TIMESTAMP_NTZ as microseconds since the epoch, whatever the session's zone."""
    since = (ts - F.expr(_ORIGIN)).cast("interval second").cast("decimal(20,6)")
    return (since * 1_000_000).cast("long")


def window_start(ts: Column | str, width: str) -> Column:
    """Start of the tumbling window a time falls into. NULL for NULL.

    ``F.window`` drops rows without a time, which an outer join must keep.
    """
    ts = col(ts) if isinstance(ts, str) else ts
    any_time = F.coalesce(ts, F.expr(_ORIGIN))
    return F.when(ts.isNotNull(), F.window(any_time, width).getField("start"))


def window_counts(
    events: DataFrame, key: str, ts: str, size: str, slide: str, first: Column | None = None, tasks: int | None = None
) -> DataFrame:
    """Count per key and hopping window: (w_start, key, num).

    Rows are counted per slide-long pane first. Only those counts are copied
    into the overlapping windows, so the copying grows with panes and keys and
    not with rows, and a hot key leaves each map task as one row per pane.
    Windows that start before ``first``, if not told the first event's pane, are
    dropped. Rows without a key or a time are counted nowhere. The counts of panes
    are dealt out by key before they are copied, so the copies are summed in place.
    They are small, and the sums of their copies are not: large inputs need ``tasks``,
    as adaptive execution goes by what is shuffled.
    """
    if micros(size) % micros(slide):
        raise ValueError(f"slide {slide!r} must divide size {size!r}")
    if first is None:
        first = events.agg(F.min(ts).alias("t")).select(window_start("t", slide)).scalar()
    panes = (
        events.filter(col(key).isNotNull())
        .select(F.window(ts, slide).getField("start").alias("pane"), key)
        .groupBy("pane", key)
        .agg(F.count(F.lit(1)).alias("num"))
    )
    starts = F.sequence(col("pane") - interval(size) + interval(slide), col("pane"), interval(slide))
    return (
        (panes.repartition(tasks, col(key)) if tasks else panes.repartition(col(key)))
        .select(F.explode(starts).alias("w_start"), key, "num")
        .filter(col("w_start") >= first)
        .groupBy("w_start", key)
        .agg(F.sum("num").alias("num"))
    )


def hottest(counts: DataFrame, window: str = "w_start") -> DataFrame:
    """Rows whose count equals their window's largest count; ties stay.

    The window maximum comes from a combinable aggregate. Ranking inside each
    window would bring all keys of a window to one task.

    Both sides of the join state the same non-null filter. Spark would
    otherwise infer a different one for each, and then compute the counts twice
    instead of reading one shuffle twice.
    """
    counts = counts.filter(col(window).isNotNull() & col("num").isNotNull())
    peaks = counts.groupBy(col(window).alias("peak_window")).agg(F.max("num").alias("peak"))
    return counts.join(
        peaks, (col(window) == col("peak_window")) & (col("num") == col("peak"))
    ).drop("peak_window", "peak")


def hot_items(
    events: DataFrame, key: str, ts: str, size: str, slide: str, first: Column | None = None, tasks: int | None = None
) -> DataFrame:
    """(w_start, w_end, key, num) of every window's most frequent keys."""
    return hottest(window_counts(events, key, ts, size, slide, first, tasks)).select(
        "w_start", (col("w_start") + interval(size)).alias("w_end"), key, "num"
    )


def label_hot_rows(
    events: DataFrame, key: str, ts: str, size: str, slide: str, num: str = "num", tasks: int | None = None
) -> DataFrame:
    """Every row, with its key and best count if the key led a window the row is in.

    All rows of a key in one pane share the answer, so winners go back to panes
    (one row per pane and key) and rows look theirs up.
    """
    winners = hot_items(events, key, ts, size, slide, tasks=tasks)
    best = (
        winners.select(
            col(key).alias("hot_key"),
            "num",
            # The panes of [w_start, w_end).
            F.explode(
                F.sequence(col("w_start"), col("w_end") - interval(slide), interval(slide))
            ).alias("hot_pane"),
        )
        .groupBy("hot_key", "hot_pane")
        .agg(F.max("num").alias(num))
    )
    placed = events.withColumn("pane", window_start(ts, slide))
    return (
        placed.join(best, (col(key) == col("hot_key")) & (col("pane") == col("hot_pane")), "left")
        .withColumn(key, col("hot_key"))
        .drop("hot_key", "hot_pane", "pane")
    )


def match_in_window(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_ts: str,
    right_ts: str,
    size: str,
    how: str = "inner",
) -> DataFrame:
    """Join rows with equal keys whose times fall into the same tumbling window.

    Key and window start are both equality keys, so the join hashes on the pair.
    The window start of the right side comes out as ``w_start``.
    """
    a = left.withColumn("left_start", window_start(left_ts, size))
    b = right.withColumn("w_start", window_start(right_ts, size))
    on = (col(left_key) == col(right_key)) & (col("left_start") == col("w_start"))
    return a.join(b, on, how).drop("left_start")
