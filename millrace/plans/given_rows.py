"""Row kernels over the given tables: any DataFrame with the right columns will do.

Only kernels whose columns the tables have, and whose dates they reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.row_kernels import KERNELS
from ..sources.tables import table

col = F.col
Query = Callable[[SparkSession, str], DataFrame]


def days(name: str) -> Column:
    return F.unix_date(col(name).cast("date"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_shipdate_days", days("l_shipdate"))


def lines_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines(spark, sf_dir).join(parts, col("l_partkey") == col("p_partkey"))


def lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", days("o_orderdate").alias("o_orderdate_days"))
        .join(customers, col("o_custkey") == col("c_custkey"))
    )
    return lines(spark, sf_dir).join(orders, col("l_orderkey") == col("o_orderkey"))


INPUTS = {
    "tpch_q1": lines,
    "tpch_q3": lines_with_orders,
    "tpch_q14": lines_with_parts,
    "tpch_q15": lines,
}


def queries() -> dict[str, Query]:
    def bind(name: str, source: Query) -> Query:
        return lambda spark, sf_dir: KERNELS[name](source(spark, sf_dir))

    return {f"given_rows_{name}": bind(name, source) for name, source in INPUTS.items()}
