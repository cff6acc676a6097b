"""The 22 decision-support queries as row classifiers.

Each kernel keeps every input row and says whether the query's predicate holds
for it and what the row contributes. A kernel is one projection: no shuffle, no
Python worker, a single generated-code stage over whatever DataFrame has the
expected columns. A NULL input makes a predicate fail, never the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fixed_values as fx

col = F.col

Kernel = Callable[[DataFrame], DataFrame]
KERNELS: dict[str, Kernel] = {}


def _kernel(fn: Kernel) -> Kernel:
    KERNELS[f"tpch_{fn.__name__}"] = fn
    return fn


def overhead() -> Column:
    """The instrumentation column: constant where there is no Python worker to time."""
    return F.lit(1).cast("long").alias("overhead")


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def value_if(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0.0))


def half_open(days: str, start: int, end: int) -> Column:
    return (col(days) >= start) & (col(days) < end)


def net_price() -> Column:
    return col("l_extendedprice") * (F.lit(1.0) - col("l_discount"))


def kernel_year(days: str) -> Column:
    return F.floor(col(days) / fx.KERNEL_YEAR_DAYS) + 1970


def _with_filter(hit: Column, *columns: Column) -> list[Column]:
    return [*columns, flag(hit).alias("passed_filter"), overhead()]


@_kernel
def q1(df: DataFrame) -> DataFrame:
    hit = col("l_shipdate_days") <= fx.DAY_1998_09_02
    charge = net_price() * (F.lit(1.0) + col("l_tax"))
    return df.select(
        "l_returnflag",
        "l_linestatus",
        value_if(hit, net_price()).alias("disc_price"),
        value_if(hit, charge).alias("charge"),
        flag(hit).alias("passed_filter"),
        overhead(),
    )


@_kernel
def q2(df: DataFrame) -> DataFrame:
    hit = (col("s_region") == "EUROPE") & (col("p_size") == 15) & col("p_type").endswith("BRASS")
    return df.select("s_name", "s_nation", "p_partkey", "ps_supplycost", *_with_filter(hit))


@_kernel
def q3(df: DataFrame) -> DataFrame:
    cut = fx.DAY_1995_03_15
    hit = (
        (col("c_mktsegment") == "BUILDING")
        & (col("o_orderdate_days") < cut)
        & (col("l_shipdate_days") > cut)
    )
    return df.select(
        "l_orderkey",
        value_if(hit, net_price()).alias("revenue"),
        col("o_orderdate_days").cast("long").alias("o_orderdate"),
        *_with_filter(hit),
    )


@_kernel
def q4(df: DataFrame) -> DataFrame:
    return df.select(
        "o_orderpriority",
        flag(col("l_commitdate_days") < col("l_receiptdate_days")).alias("is_late"),
        flag(half_open("o_orderdate_days", fx.DAY_1993_07_01, fx.DAY_1993_10_01)).alias("in_range"),
        overhead(),
    )


@_kernel
def q5(df: DataFrame) -> DataFrame:
    hit = (
        (col("r_name") == "ASIA")
        & (col("c_nation") == col("s_nation"))
        & half_open("o_orderdate_days", fx.DAY_1994_01_01, fx.DAY_1995_01_01)
    )
    return df.select(
        col("c_nation").alias("n_name"),
        value_if(hit, net_price()).alias("revenue"),
        *_with_filter(hit),
    )


@_kernel
def q6(df: DataFrame) -> DataFrame:
    hit = (
        half_open("l_shipdate_days", fx.DAY_1994_01_01, fx.DAY_1995_01_01)
        & col("l_discount").between(0.05, 0.07)
        & (col("l_quantity") < 24)
    )
    gain = col("l_extendedprice") * col("l_discount")
    return df.select(value_if(hit, gain).alias("revenue_part"), overhead())


@_kernel
def q7(df: DataFrame) -> DataFrame:
    pair = fx.Q7_NATIONS
    hit = (
        col("l_shipdate_days").between(fx.DAY_1995_01_01, fx.DAY_1996_12_31)
        & col("s_nation").isin(*pair)
        & col("c_nation").isin(*pair)
        & (col("s_nation") != col("c_nation"))
    )
    return df.select(
        F.when(hit, col("s_nation")).alias("supp_nation"),
        F.when(hit, col("c_nation")).alias("cust_nation"),
        F.when(hit, kernel_year("l_shipdate_days")).alias("l_year"),
        value_if(hit, net_price()).alias("volume"),
        *_with_filter(hit),
    )


@_kernel
def q8(df: DataFrame) -> DataFrame:
    hit = (
        (col("c_region") == "AMERICA")
        & (col("p_type") == "ECONOMY ANODIZED STEEL")
        & col("o_orderdate_days").between(fx.DAY_1995_01_01, fx.DAY_1996_12_31)
    )
    return df.select(
        F.when(hit, kernel_year("o_orderdate_days")).otherwise(0).cast("long").alias("o_year"),
        value_if(hit, net_price()).alias("volume"),
        value_if(hit & (col("s_nation") == "BRAZIL"), net_price()).alias("nation_volume"),
        *_with_filter(hit),
    )


@_kernel
def q9(df: DataFrame) -> DataFrame:
    hit = col("p_name").contains("green")
    profit = net_price() - col("ps_supplycost") * col("l_quantity")
    return df.select(
        col("s_nation").alias("nation"),
        F.when(hit, kernel_year("o_orderdate_days")).otherwise(0).cast("long").alias("o_year"),
        value_if(hit, profit).alias("profit"),
        *_with_filter(hit),
    )


@_kernel
def q10(df: DataFrame) -> DataFrame:
    hit = (col("l_returnflag") == "R") & half_open(
        "o_orderdate_days", fx.DAY_1993_10_01, fx.DAY_1994_01_01
    )
    return df.select(
        "c_custkey",
        "c_name",
        "c_nation",
        value_if(hit, net_price()).alias("revenue"),
        *_with_filter(hit),
    )


@_kernel
def q11(df: DataFrame) -> DataFrame:
    hit = col("s_nation") == "GERMANY"
    return df.select(
        "ps_partkey",
        value_if(hit, col("ps_supplycost") * col("ps_availqty")).alias("part_value"),
        *_with_filter(hit),
    )


@_kernel
def q12(df: DataFrame) -> DataFrame:
    hit = (
        col("l_shipmode").isin(fx.Q12_MODES)
        & (col("l_shipdate_days") < col("l_commitdate_days"))
        & (col("l_commitdate_days") < col("l_receiptdate_days"))
        & half_open("l_receiptdate_days", fx.DAY_1994_01_01, fx.DAY_1995_01_01)
    )
    urgent = col("o_orderpriority").isin(fx.URGENT_PRIORITIES)
    return df.select(
        "l_shipmode",
        flag(hit & urgent).alias("high_line"),
        flag(hit & ~urgent).alias("low_line"),
        *_with_filter(hit),
    )


@_kernel
def q13(df: DataFrame, words: tuple[str, str] = ("special", "requests")) -> DataFrame:
    return df.select(
        "c_custkey",
        flag(~col("o_comment").rlike(".*".join(words))).alias("is_valid"),
        overhead(),
    )


@_kernel
def q14(df: DataFrame) -> DataFrame:
    hit = half_open("l_shipdate_days", fx.DAY_1995_09_01, fx.DAY_1995_10_01)
    return df.select(
        value_if(hit & col("p_type").startswith("PROMO"), net_price()).alias("promo_value"),
        value_if(hit, net_price()).alias("total_value"),
        overhead(),
    )


@_kernel
def q15(df: DataFrame) -> DataFrame:
    hit = half_open("l_shipdate_days", fx.Q15_FROM_DAY, fx.Q15_TO_DAY)
    return df.select(
        "l_suppkey", value_if(hit, net_price()).alias("revenue"), *_with_filter(hit)
    )


@_kernel
def q16(df: DataFrame) -> DataFrame:
    hit = (
        (col("p_brand") != "Brand#45")
        & ~col("p_type").startswith("MEDIUM POLISHED")
        & col("p_size").isin(fx.Q16_SIZES)
        & (col("is_complaint") == 0)
    )
    return df.select(
        "p_brand",
        "p_type",
        col("p_size").cast("long").alias("p_size"),
        "ps_suppkey",
        *_with_filter(hit),
    )


@_kernel
def q17(df: DataFrame) -> DataFrame:
    hit = (
        (col("p_brand") == "Brand#23")
        & (col("p_container") == "MED BOX")
        & (col("l_quantity") < F.lit(0.2) * col("avg_quantity"))
    )
    return df.select(value_if(hit, col("l_extendedprice")).alias("revenue_part"), *_with_filter(hit))


@_kernel
def q18(df: DataFrame) -> DataFrame:
    hit = col("order_total_qty") > 300
    return df.select(
        "c_name",
        "c_custkey",
        "o_orderkey",
        "o_totalprice",
        col("order_total_qty").alias("total_quantity"),
        *_with_filter(hit),
    )


# FIXED VALUES: brand, containers, quantity range and largest size of each Q19 branch.
Q19_BRANCHES = [
    ("Brand#12", ["SM CASE", "SM BOX", "SM PACK", "SM PKG"], (1, 11), 5),
    ("Brand#23", ["MED BAG", "MED BOX", "MED PKG", "MED PACK"], (10, 20), 10),
    ("Brand#34", ["LG CASE", "LG BOX", "LG PACK", "LG PKG"], (20, 30), 15),
]


@_kernel
def q19(df: DataFrame) -> DataFrame:
    # The branches name different brands, so at most one of them holds.
    any_branch = F.lit(False)
    for brand, containers, (low, high), max_size in Q19_BRANCHES:
        any_branch = any_branch | (
            (col("p_brand") == brand)
            & col("p_container").isin(*containers)
            & col("l_quantity").between(low, high)
            & col("p_size").between(1, max_size)
        )
    hit = (
        (col("l_shipinstruct") == "DELIVER IN PERSON")
        & col("l_shipmode").isin("AIR", "AIR REG")
        & any_branch
    )
    return df.select(value_if(hit, net_price()).alias("revenue_part"), overhead())


@_kernel
def q20(df: DataFrame) -> DataFrame:
    hit = (
        (col("s_nation") == "CANADA")
        & col("p_name").startswith("forest")
        & half_open("l_shipdate_days", fx.DAY_1994_01_01, fx.DAY_1995_01_01)
        & (col("shipped_qty") > F.lit(0.5) * col("ps_availqty"))
    )
    return df.select("s_name", "s_address", *_with_filter(hit))


@_kernel
def q21(df: DataFrame) -> DataFrame:
    hit = (
        (col("s_nation") == "SAUDI ARABIA")
        & (col("o_orderstatus") == "F")
        & (col("l_receiptdate_days") > col("l_commitdate_days"))
        & (col("has_other_supplier") == 1)
        & (col("other_also_late") == 0)
    )
    return df.select("s_name", flag(hit).alias("numwait"), *_with_filter(hit))


@_kernel
def q22(df: DataFrame) -> DataFrame:
    hit = (
        col("cntrycode").isin(*fx.SALES_CODES)
        & (col("c_acctbal") > col("avg_acctbal"))
        & (col("has_orders") == 0)
    )
    return df.select("cntrycode", "c_acctbal", *_with_filter(hit))
