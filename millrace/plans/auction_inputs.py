"""The auction stream of the given tables.

Persons are customers, who register on the first of January 1995 plus as many days
as their key says (a cycle of 2,400 days); their city is their market segment and
their state one of fifty by nation and key. Auctions are orders: the seller is the
customer, the category the priority's number times five or, for every other order,
one by the key. Bids are lines: the auction is the part, the time is the day the
line was shipped. Times are milliseconds since the epoch; windows are in days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixed_values as fx
from ..sources.tables import table
from .row_inputs import chosen

col = F.col
DAY_MS = 86_400_000
FIRST_DAY, CYCLE_DAYS = 9131, 2400


def midnight_ms(ts: str) -> Column:
    return F.unix_date(col(ts).cast("date")).cast("long") * DAY_MS


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(FIRST_DAY) + F.pmod(col("c_custkey") * 7, F.lit(CYCLE_DAYS))
    return table(spark, sf_dir, "customer").select(
        col("c_custkey").alias("p_id"), col("c_name").alias("name"), col("c_mktsegment").alias("city"),
        chosen(fx.US_STATES, col("c_nationkey") + col("c_custkey")).alias("state"), (day * DAY_MS).cast("long").alias("p_date_time"),
    )


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.substring("o_orderpriority", 1, 1).cast("int") * 5
    category = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, priority).otherwise(F.pmod("o_orderkey", F.lit(20)))
    return table(spark, sf_dir, "orders").select(
        col("o_orderkey").alias("a_id"), col("o_custkey").alias("seller"), category.cast("int").alias("category"),
        midnight_ms("o_orderdate").alias("a_date_time"),
    )


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (col("l_orderkey") * 8 + col("l_linenumber")).alias("bid_id"), col("l_partkey").alias("auction"),
        midnight_ms("l_shipdate").alias("date_time"),
    )
