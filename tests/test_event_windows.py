"""Event windows against brute force on small random inputs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import event_windows as ew
from millrace.plans.nexmark import new_user_purchases

START = datetime(2024, 3, 9, 23, 0, 1)  # a daylight-saving change follows in some zones


def random_events(seed, rows=400, keys=6, seconds=240):
    rng = random.Random(seed)
    return [
        (i, rng.choice("aaab" + "cdef"[: keys - 2]), START + timedelta(milliseconds=rng.randrange(seconds * 1000)))
        for i in range(rows)
    ]


def brute_hot(events, size, slide):
    """{window start: (count, keys)} with windows from the first event's slide on."""
    micros = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)
    first = min(micros(t) for _, _, t in events) // slide * slide
    counts = defaultdict(Counter)
    for _, key, t in events:
        newest = micros(t) // slide * slide
        for start in range(newest - size + slide, newest + slide, slide):
            if start >= first:
                counts[start][key] += 1
    return {
        w: (max(c.values()), {k for k, n in c.items() if n == max(c.values())})
        for w, c in counts.items()
    }, first


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hot_items_and_rows(spark, seed, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = random_events(seed)
        want, _ = brute_hot(events, 10_000, 2_000)
        df = spark.createDataFrame(events, "id long, key string, ts timestamp_ntz")
        hot = ew.hot_items(df, "key", "ts", "10 seconds", "2 seconds")
        got = defaultdict(set)
        for r in hot.select(ew.utc_micros(F.col("w_start")).alias("w"), "key", "num").collect():
            got[r.w // 1000].add((r.key, r.num))
        assert got == {w: {(k, n) for k in keys} for w, (n, keys) in want.items()}

        rows = ew.label_hot_rows(df, "key", "ts", "10 seconds", "2 seconds").collect()
        assert len(rows) == len(events)
        by_id = {r.id: (r.key, r.num) for r in rows}
        for i, key, t in events:
            ms = int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)
            wins = [n for w, (n, keys) in want.items() if key in keys and w <= ms < w + 10_000]
            assert by_id[i] == ((key, max(wins)) if wins else (None, None))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rows_without_a_time_or_key_are_kept(spark):
    df = spark.createDataFrame(
        [(1, "a", START), (2, "b", None), (3, None, START)], "id long, key string, ts timestamp_ntz"
    )
    rows = ew.label_hot_rows(df, "key", "ts", "10 seconds", "2 seconds").collect()
    assert {r.id: r.key for r in rows} == {1: "a", 2: None, 3: None}


def test_slide_must_divide_size(spark):
    df = spark.createDataFrame([("a", START)], "key string, ts timestamp_ntz")
    with pytest.raises(ValueError):
        ew.hot_items(df, "key", "ts", "10 seconds", "3 seconds")


def test_match_in_window_is_half_open_and_outer(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    left = spark.createDataFrame(
        [(1, 7, at(0)), (2, 7, at(9.999)), (3, 7, at(10)), (4, 7, None)],
        "a_id long, seller long, a_ts timestamp_ntz",
    )
    right = spark.createDataFrame([(7, at(5))], "p_id long, p_ts timestamp_ntz")
    rows = ew.match_in_window(left, right, "seller", "p_id", "a_ts", "p_ts", "10 seconds", "left")
    assert {r.a_id: r.p_id for r in rows.collect()} == {1: 7, 2: 7, 3: None, 4: None}


def test_several_signups_give_one_row_per_purchase(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    events = spark.createDataFrame(
        [(1, 9, "signup", at(1)), (2, 9, "signup", at(2)), (3, 9, "purchase", at(3)),
         (4, 9, "purchase", at(7)), (5, 8, "purchase", at(1))],
        "event_id long, user_id long, event_type string, ts timestamp_ntz",
    )
    rows = new_user_purchases(events).collect()
    assert [(r.event_id, r.signup_ts) for r in rows] == [(3, at(1))]
