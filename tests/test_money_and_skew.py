from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.functions.money import exact_sum, exact_total, hundredths
from millrace.operators.skew import group_after_join


def test_sums_are_exact_and_do_not_overflow(spark):
    rng = random.Random(1)
    values = [rng.randrange(-(10**15), 10**15) for _ in range(500)] + [2**62, 2**62, 2**62, -1, 0]
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(7)
    assert df.agg(exact_total(F.col("x"))).first()[0] == Decimal(sum(values))
    assert df.agg(exact_sum(F.col("x"), 4)).first()[0] == float(Decimal(sum(values)) / 10**4)


def test_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "x long")
    assert df.agg(exact_sum(F.col("x"), 2)).first()[0] is None


def test_hundredths_undo_binary_noise(spark):
    amounts = [0.29, 1.005, 900.1, 104_949.99, -0.07]
    df = spark.createDataFrame([(a,) for a in amounts], "x double")
    got = [r[0] for r in df.select(hundredths("x")).collect()]
    assert got == [29, 100, 90_010, 10_494_999, -7]


def test_grouping_after_a_join_lets_adaptive_execution_split_the_hot_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = spark.range(0, 300_000, 1, 12).select(
            F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("k"),
            F.hash("id").alias("v"),
        )
        orders = spark.range(0, 1000, 1, 2).select(F.col("id").alias("o"))
        joined = lines.join(orders, F.col("k") == F.col("o"))
        split = group_after_join(joined, ["k"], F.sum("v").alias("s"), F.count("v").alias("n"))
        plain = joined.groupBy("k").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
        assert sorted(split.collect()) == sorted(plain.collect())
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan(split)
        assert "skew=true" not in plan(plain)
    finally:
        for key in settings:
            spark.conf.unset(key)
