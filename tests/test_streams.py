"""Streams over several files and triggers give what the batch form gives."""

from __future__ import annotations

import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.operators import event_windows as ew
from millrace.sources.workspace import fresh_folder, shared_folder
from millrace.streaming import auctions, prices, runs
from millrace.streaming.datagen import datagen_stream

TIMEOUT = 180


def in_files(spark, df, order, files):
    """Write rows as several files in time order, each newer than the last."""
    path = fresh_folder(spark, "test-input")
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def events(spark, rows=600):
    start = datetime(2024, 1, 1)
    data = [(i, "aab"[i % 3] + str(i % 4), start + timedelta(seconds=i * 0.5)) for i in range(rows)]
    return spark.createDataFrame(data, "id long, key string, ts timestamp_ntz")


def test_hot_items_over_files_equal_the_batch_up_to_the_watermark(spark):
    df = events(spark)
    path = in_files(spark, df, "ts", 4)
    stream = runs.table_stream(spark, path, df.schema, files_per_trigger=1).select(
        "key", auctions.instant("ts").alias("ts")
    )
    origin = df.agg(ew.utc_micros(F.min("ts"))).first()[0] // 1000
    got = auctions.hot_items_stream(
        stream, "key", "ts", "20 seconds", "10 seconds", "5 seconds", origin, TIMEOUT
    )
    last = df.agg(ew.utc_micros(F.max("ts"))).first()[0] // 1000 - 5_000
    want = (
        ew.hot_items(df, "key", "ts", "20 seconds", "10 seconds")
        .select(
            (ew.utc_micros(F.col("w_start")) / 1000).cast("long").alias("w_start"),
            (ew.utc_micros(F.col("w_end")) / 1000).cast("long").alias("w_end"),
            "key",
            "num",
        )
        .filter(F.col("w_end") <= last)
    )
    assert want.count() > 20
    assert Counter(got.collect()) == Counter(want.collect())


def test_new_sellers_over_files_equal_the_batch(spark):
    start = datetime(2024, 1, 1)
    persons = spark.createDataFrame(
        [(i, f"p{i}", start + timedelta(seconds=i)) for i in range(120)],
        "p_id long, name string, p_ts timestamp",
    )
    opened = spark.createDataFrame(
        [(i, (i * 7) % 120, start + timedelta(seconds=i * 0.4)) for i in range(300)],
        "a_id long, seller long, a_ts timestamp",
    )
    p = runs.table_stream(spark, in_files(spark, persons, "p_ts", 3), persons.schema, files_per_trigger=1)
    a = runs.table_stream(spark, in_files(spark, opened, "a_ts", 3), opened.schema, files_per_trigger=1)
    got = auctions.new_sellers_stream(p, a, "10 seconds", "1 minute", TIMEOUT)
    want = ew.match_in_window(opened, persons, "seller", "p_id", "a_ts", "p_ts", "10 seconds").select(
        F.col("p_id").alias("person_id"), "name", F.unix_millis("w_start").alias("starttime"),
        F.col("a_id").alias("auction_id"),
    )
    assert want.count() > 5
    assert Counter(got.collect()) == Counter(want.collect())


def test_retried_batch_replaces_its_output(spark):
    """The second output fails once; the same stream, run again, gives what an untroubled run gives."""
    stream = runs.as_stream(spark.range(10))
    base = fresh_folder(spark, "retry")
    troubled = []

    def second(batch):
        if batch.isStreaming or not troubled:
            troubled.append(True)
            return batch.filter(F.when(F.col("id") < 100, F.raise_error(F.lit("once"))).isNull())
        return batch.filter("id > 6")

    with pytest.raises(Exception, match="once"):
        runs.batches_to_tables(stream, "retry", {"a": lambda b: b, "b": second}, TIMEOUT, base)
    out = runs.batches_to_tables(stream, "retry", {"a": lambda b: b, "b": second}, TIMEOUT, base)
    assert sorted(r.id for r in out["a"].collect()) == list(range(10))
    assert sorted(r.id for r in out["b"].collect()) == [7, 8, 9]


def test_a_stream_without_rows_gives_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, batch_id int")
    out = runs.batches_to_tables(runs.as_stream(empty), "none", {"a": lambda b: b.select("batch_id")}, TIMEOUT)
    assert out["a"].columns == ["batch_id"] and out["a"].count() == 0


LAYOUTS = ["parts", "partitioned"]
STREAMS = [n for n in queries() if n.startswith(("stream_", "src_stream"))]


@pytest.fixture(scope="module")
def laid_out(spark, sf_dir, tmp_path_factory):
    """The streamed tables as a folder of four files, and partitioned by a column."""
    folders = {}
    for layout in LAYOUTS:
        folder = folders[layout] = str(tmp_path_factory.mktemp(layout))
        for name, by in (("events", "event_type"), ("lineitem", "l_linestatus")):
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            writer = df.repartition(4).write if layout == "parts" else df.write.partitionBy(by)
            writer.parquet(f"{folder}/{name}.parquet")
    return folders


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("name", STREAMS)
def test_layout_of_a_table_makes_no_difference(spark, sf_dir, laid_out, name, layout):
    query = queries()[name]
    want, got = query(spark, sf_dir), query(spark, laid_out[layout])
    columns = sorted(want.columns)
    assert want.count() > 0
    assert Counter(got.select(columns).collect()) == Counter(want.select(columns).collect())


@pytest.mark.parametrize("name", ["stream_nexmark_q5", "stream_nexmark_q8", "stream_nexmark_q8_outer", "stream_ev_hot_types"])
def test_files_out_of_order_lose_nothing(spark, sf_dir, tmp_path, monkeypatch, name):
    """The latest events are in the first file, and every file is a micro-batch."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = df.orderBy(F.desc("ts")).collect()
    step = -(-len(rows) // 3)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.05)
    want = queries()[name](spark, sf_dir)
    columns, expected = sorted(want.columns), want.collect()
    monkeypatch.setattr(runs, "BATCH_BYTES", 1)
    got = queries()[name](spark, str(tmp_path))
    assert expected and Counter(got.select(columns).collect()) == Counter(want.select(columns).collect())


def test_dropped_rows_are_an_error(spark):
    df = events(spark)
    late = in_files(spark, df.withColumn("order", -F.col("id")), "order", 3)
    stream = runs.table_stream(spark, late, spark.read.parquet(late).schema, files_per_trigger=1).select("key", auctions.instant("ts").alias("ts"))
    with pytest.raises(RuntimeError, match="dropped"):
        auctions.hot_items_stream(stream, "key", "ts", "20 seconds", "10 seconds", "5 seconds", timeout_s=TIMEOUT)
    table = spark.read.parquet(late)
    assert runs.disorder(table, "ts") > 150_000_000 and runs.disorder(table.filter("id < 0"), "ts") == 0


def test_a_missing_table_is_an_error(spark, sf_dir):
    with pytest.raises(FileNotFoundError):
        runs.table_stream(spark, f"{sf_dir}/nothing.parquet", spark.range(1).schema)


def sides(spark):
    """Persons and auctions over ten windows of ten seconds; of the auctions, some sellers never register."""
    start = datetime(2024, 1, 1)
    persons = [(i, f"p{i}", start + timedelta(seconds=i)) for i in range(100)] + [(5, "again", start + timedelta(seconds=6))]
    opened = [(i, (i * 7) % 130, start + timedelta(seconds=i / 3)) for i in range(300)] + [(900, None, start), (901, 5, start + timedelta(seconds=9))]
    return (spark.createDataFrame(persons, "p_id long, name string, p_ts timestamp"),
            spark.createDataFrame(opened, "a_id long, seller long, a_ts timestamp"))


def outer_answer(persons, opened):
    return ew.match_in_window(opened, persons, "seller", "p_id", "a_ts", "p_ts", "10 seconds", "left").select(
        F.col("p_id").alias("person_id"), "name", F.unix_millis("w_start").alias("starttime"),
        F.when(F.col("p_id").isNotNull(), F.col("a_id")).alias("auction_id"))


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("salts", [1, 8])
def test_auctions_without_a_seller_give_a_row_of_nulls(spark, files, salts):
    persons, opened = sides(spark)
    p = runs.table_stream(spark, in_files(spark, persons, "p_ts", files), persons.schema, files_per_trigger=1)
    a = runs.table_stream(spark, in_files(spark, opened, "a_ts", files), opened.schema, files_per_trigger=1)
    got = auctions.new_sellers_stream(p, a, "10 seconds", "1 minute", TIMEOUT, salts, "left").collect()
    want = outer_answer(persons, opened).collect()
    assert Counter(got) == Counter(want) and 0 < sum(r.person_id is None for r in want) < len(want) == len(got)


def test_rows_of_nulls_wait_for_the_watermark(spark, monkeypatch):
    """Without the closing event the windows of the last minute may still find their sellers."""
    monkeypatch.setattr(runs.ClosingEvent, "let_in", lambda self: None)
    persons, opened = sides(spark)
    got = auctions.new_sellers_stream(runs.as_stream(persons), runs.as_stream(opened), "10 seconds", "1 minute", TIMEOUT, how="left")
    want = outer_answer(persons, opened.filter("a_ts < '2024-01-01 00:00:30'")).filter("person_id IS NULL")
    assert got.filter("person_id IS NULL").count() == want.count() > 0
    assert got.filter("person_id IS NOT NULL").count() == outer_answer(persons, opened).filter("person_id IS NOT NULL").count()


@pytest.mark.parametrize("files", [1, 4])
def test_a_closing_event_ends_every_window(spark, files):
    df = events(spark)
    stream = runs.table_stream(spark, in_files(spark, df, "ts", files), df.schema, files_per_trigger=1).select("key", auctions.instant("ts").alias("ts"))
    origin = df.agg(ew.utc_micros(F.min("ts"))).first()[0] // 1000
    got = auctions.hot_items_stream(stream, "key", "ts", "20 seconds", "10 seconds", "5 seconds", origin, TIMEOUT, to_the_end=True)
    want = ew.hot_items(df, "key", "ts", "20 seconds", "10 seconds").select(
        *[(ew.utc_micros(F.col(w)) / 1000).cast("long").alias(w) for w in ("w_start", "w_end")], "key", "num")
    assert Counter(got.collect()) == Counter(want.collect())


def test_no_windows_without_events(spark):
    empty = spark.createDataFrame([], "key string, ts timestamp")
    assert auctions.hot_items_stream(runs.as_stream(empty), "key", "ts", "20 seconds", "10 seconds", "5 seconds", timeout_s=TIMEOUT, to_the_end=True).count() == 0


def test_a_hot_seller_is_spread(spark):
    start = datetime(2024, 1, 1)
    persons = spark.createDataFrame([(i, f"p{i}", start) for i in range(9)], "p_id long, name string, p_ts timestamp")
    opened = spark.createDataFrame([(i, 3 if i % 3 == 0 else i % 9, start) for i in range(300)], "a_id long, seller long, a_ts timestamp")
    got = auctions.new_sellers_stream(runs.as_stream(persons), runs.as_stream(opened), "10 seconds", "1 minute", TIMEOUT)
    assert sorted(r.auction_id for r in got.collect()) == list(range(300))


def test_restart_continues_after_the_last_batch(spark):
    df = spark.range(20).select(F.col("id"))
    path = in_files(spark, df, "id", 2)
    base = fresh_folder(spark, "restart")

    def write():
        stream = runs.table_stream(spark, path, df.schema)
        sink = stream.writeStream.format("parquet").option("path", f"{base}/rows")
        runs.finish(sink, f"{base}/checkpoint", TIMEOUT)
        return spark.read.parquet(f"{base}/rows").count()

    assert write() == 20
    spark.range(20, 25).write.mode("append").parquet(path)
    assert write() == 25


def test_failures_are_raised(spark):
    bad = F.raise_error(F.lit("broken row"))
    stream = runs.as_stream(spark.range(3)).select(F.when(F.col("id") == 1, bad).alias("x"))
    with pytest.raises(Exception, match="broken row"):
        runs.to_table(stream, "failing", TIMEOUT)


def test_datagen(spark):
    rows = runs.to_table(datagen_stream(spark, 250, 100, partitions=2), "datagen", TIMEOUT)
    first = rows.agg(F.min("id"), F.count("id"), F.count_distinct("id"), F.max("id")).first()
    assert first[0] == 1 and first[1] == first[2] == first[3] <= 250
    assert rows.filter("price < 1 OR price >= 100 OR quantity NOT BETWEEN 1 AND 10").count() == 0


def test_datagen_takes_one_rate(spark):
    assert datagen_stream(spark, 10, rows_per_second=5, partitions=1).isStreaming
    with pytest.raises(ValueError):
        datagen_stream(spark, 10)
    with pytest.raises(ValueError):
        datagen_stream(spark, 10, 5, rows_per_second=5)


def test_datagen_by_the_second_ends_at_the_last_row(spark):
    stream = datagen_stream(spark, 30, rows_per_second=20, partitions=1)
    base = fresh_folder(spark, "by-the-second")
    query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/c").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if sum(p["numInputRows"] for p in query.recentProgress) >= 30:
                break
    finally:
        query.stop()
    ids = [r.id for r in spark.read.parquet(f"{base}/rows").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1)) and 0 < len(ids) <= 30


def test_price_stream_columns(spark):
    stream = runs.as_stream(spark.range(50).select("id", F.col("id").cast("double").alias("price")))
    rows = runs.to_table(prices.stepped(stream), "stepped", TIMEOUT)
    assert rows.columns == ["id", "price", "totalRoundTrip", "pyDurationNs", "overhead"]
    for r in rows.collect():
        assert r.price == r.id + 1.0
        assert r.overhead == r.totalRoundTrip - r.pyDurationNs and r.pyDurationNs >= 0


def test_idle_value_is_the_price(spark):
    row = spark.createDataFrame([(1, 5.0, 2)], "id int, price double, quantity int")
    assert prices.valued(row, idle=True).first().value == 5.0
    assert abs(prices.valued(row).first().value - 11.791759469228055) < 1e-12


def test_literal_rows_as_a_stream(spark):
    rows = [(1, "five"), (2, "rows"), (3, "of"), (4, "plain"), (5, "text")]
    words = spark.createDataFrame(rows, "id int, word string")
    assert sorted(map(tuple, runs.to_table(runs.as_stream(words), "words", TIMEOUT).collect())) == rows
    # The console and noop sinks leave nothing to read: they must run to the end.
    runs.print_stream(runs.as_stream(words), timeout_s=TIMEOUT)
    runs.discard(runs.as_stream(words), TIMEOUT)


class _Cluster:
    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_without_a_setting_only_a_plain_local_session_uses_its_own_disk():
    def session(master, warehouse):
        class conf:
            get = staticmethod(lambda key, default: warehouse if key == "spark.sql.warehouse.dir" else default)

        context = type("context", (), {"master": master, "getConf": staticmethod(dict)})
        return type("session", (), {"conf": conf, "sparkContext": context})

    for master in ("local", "local[4]", "local[*]"):
        assert shared_folder(session(master, "file:/data/warehouse")) == "file:/data/warehouse/.millrace"
    assert shared_folder(session("spark://host:7077", "hdfs://host/warehouse")) == "hdfs://host/warehouse/.millrace"
    for master in ("local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master, "file:/data/warehouse"))


def test_no_local_folder_on_a_cluster(spark):
    with pytest.raises(RuntimeError):
        shared_folder(_Cluster())
    assert fresh_folder(spark, "x").startswith(shared_folder(spark) + "/x-")
