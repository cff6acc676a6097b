"""The 22 decision-support queries in relational form, on the given tables.

Rules the plans follow, so that they hold when ``lineitem`` is a thousand times
larger and one key owns a third of it:

* Filters and the columns a query needs are stated before any join, so they
  reach the parquet scan.
* ``lineitem`` is reduced to its join key *before* the join wherever the query
  allows it. The reduction combines on the map side, so a hot key arrives as
  one row per map task, and the join reuses the reduction's partitioning.
* Where a filter has to come first, the grouping after the join shuffles anew
  (``operators.skew``), which lets adaptive execution split a hot key's join.
* EXISTS, NOT EXISTS and per-group extremes are aggregates, never a self join of
  raw rows or a window over them.
* No broadcast hints: Spark broadcasts a side when its measured size is under
  the session's threshold, and shuffles or splits skewed partitions otherwise.
* Money is summed exactly (see ``functions.money``).

The tables have no part-supplier table, ship modes, containers, or commit and
receipt dates; the bindings that stand in for them are stated at each query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import (
    as_double,
    charge_units,
    exact_sum,
    exact_total,
    hundredths,
    net_units,
)
from ..operators.skew import group_after_join
from ..sources import fixed_values as fx
from ..sources.tables import table

col = F.col
Query = Callable[[SparkSession, str], DataFrame]

LATE_DAYS = 90
PAIR = ["l_partkey", "l_suppkey"]
COST_DECIMALS = 4


class Tables:
    """Short names for the tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)


def day(year: int, month: int, dom: int) -> Column:
    return F.lit(dt.date(year, month, dom))


def within(name: str, start: Column, end: Column) -> Column:
    return (col(name) >= start) & (col(name) < end)


def within_year(name: str, year: int) -> Column:
    return within(name, day(year, 1, 1), day(year + 1, 1, 1))


def both_years(name: str) -> Column:
    return within(name, day(1995, 1, 1), day(1997, 1, 1))


def nation_of(t: Tables, prefix: str) -> DataFrame:
    """Nation keys and names under a prefix, for joining the table twice."""
    return t.nation.select(
        col("n_nationkey").alias(f"{prefix}_nationkey"), col("n_name").alias(f"{prefix}_nation")
    )


def nations_in(t: Tables, region: str) -> DataFrame:
    wanted = t.region.filter(col("r_name") == region)
    return t.nation.join(wanted, col("n_regionkey") == col("r_regionkey")).select(
        "n_nationkey", "n_name"
    )


def supply_cost_units() -> Column:
    """Aggregate: the lowest unit price a line was sold at, truncated to 1/10,000."""
    lowest = F.min(col("l_extendedprice") / col("l_quantity"))
    return F.floor(lowest * 10**COST_DECIMALS)


def late_line() -> Column:
    """Stands in for receipt after commit: shipped over 90 days after the order."""
    return col("l_shipdate") > col("o_orderdate") + F.expr(f"INTERVAL {LATE_DAYS} DAYS")


def q1(t: Tables) -> DataFrame:
    price = hundredths("l_extendedprice")
    lines = t.lineitem.filter(col("l_shipdate") <= day(1998, 9, 2))
    sums = lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        exact_sum(price, 2).alias("sum_base_price"),
        exact_sum(net_units(), 4).alias("sum_disc_price"),
        exact_sum(charge_units(), 6).alias("sum_charge"),
        exact_sum(hundredths("l_discount"), 2).alias("sum_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )
    return sums.select(
        "l_returnflag",
        "l_linestatus",
        "sum_qty",
        "sum_base_price",
        "sum_disc_price",
        "sum_charge",
        (col("sum_qty") / col("count_order")).alias("avg_qty"),
        (col("sum_base_price") / col("count_order")).alias("avg_price"),
        (col("sum_disc") / col("count_order")).alias("avg_disc"),
        "count_order",
    ).orderBy("l_returnflag", "l_linestatus")


def q2(t: Tables) -> DataFrame:
    """Cheapest European suppliers of each small-brass part; types here are one word."""
    parts = t.part.filter((col("p_size") == 15) & (col("p_type") == "ECONOMY")).select(
        "p_partkey", "p_brand"
    )
    suppliers = t.supplier.join(
        nations_in(t, "EUROPE"), col("s_nationkey") == col("n_nationkey")
    ).select("s_suppkey", "s_name", "s_acctbal", "n_name")
    lines = (
        t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        .join(parts.select("p_partkey"), col("l_partkey") == col("p_partkey"), "left_semi")
        .join(suppliers.select("s_suppkey"), col("l_suppkey") == col("s_suppkey"), "left_semi")
    )
    offers = group_after_join(lines, PAIR, supply_cost_units().alias("cost"))
    # min per part joined back: a window would gather all offers of a part in one task.
    lowest = offers.groupBy(col("l_partkey").alias("part")).agg(F.min("cost").alias("low"))
    cheapest = offers.join(
        lowest, (col("l_partkey") == col("part")) & (col("cost") == col("low"))
    )
    return (
        cheapest.join(parts, col("l_partkey") == col("p_partkey"))
        .join(suppliers, col("l_suppkey") == col("s_suppkey"))
        .select(
            "s_acctbal",
            "s_name",
            "n_name",
            "p_partkey",
            "p_brand",
            (col("cost") / 10**COST_DECIMALS).alias("ps_supplycost"),
        )
        .orderBy(col("s_acctbal").desc(), "n_name", "s_name", "p_partkey")
        .limit(100)
    )


def q3(t: Tables) -> DataFrame:
    cut = day(1995, 3, 15)
    builders = t.customer.filter(col("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = (
        t.orders.filter(col("o_orderdate") < cut)
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(builders, col("o_custkey") == col("c_custkey"), "left_semi")
    )
    # Few orders pass: joining them first leaves little to group.
    lines = (
        t.lineitem.filter(col("l_shipdate") > cut)
        .select("l_orderkey", "l_extendedprice", "l_discount")
        .join(orders.drop("o_custkey"), col("l_orderkey") == col("o_orderkey"))
    )
    revenue = exact_sum(net_units(), 4).alias("revenue")
    return (
        group_after_join(lines, ["l_orderkey", "o_orderdate"], revenue)
        .select("l_orderkey", "revenue", "o_orderdate")
        .orderBy(col("revenue").desc(), "o_orderdate", "l_orderkey")
        .limit(10)
    )


def q4(t: Tables) -> DataFrame:
    """Orders of a quarter with a late line, each counted once."""
    start, end = day(1996, 7, 1), day(1996, 10, 1)
    orders = t.orders.filter(within("o_orderdate", start, end)).select(
        "o_orderkey", "o_orderdate", "o_orderpriority"
    )
    lines = t.lineitem.filter(col("l_shipdate") > start).select("l_orderkey", "l_shipdate")
    late = lines.join(orders, (col("o_orderkey") == col("l_orderkey")) & late_line())
    return (
        group_after_join(late, ["o_orderkey", "o_orderpriority"], F.count(F.lit(1)).alias("lines"))
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("o_orderpriority")
    )


def q5(t: Tables) -> DataFrame:
    asia = nations_in(t, "ASIA")
    customers = t.customer.join(asia, col("c_nationkey") == col("n_nationkey"), "left_semi").select(
        "c_custkey", "c_nationkey"
    )
    orders = (
        t.orders.filter(within_year("o_orderdate", 1996))
        .select("o_orderkey", "o_custkey")
        .join(customers, col("o_custkey") == col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    local = (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
        .join(orders, col("l_orderkey") == col("o_orderkey"))
        # One row per supplier and customer nation before suppliers are looked up.
        .groupBy("l_suppkey", "c_nationkey")
        .agg(exact_total(net_units()).alias("units"))
        .join(
            t.supplier.select("s_suppkey", "s_nationkey"),
            (col("l_suppkey") == col("s_suppkey")) & (col("c_nationkey") == col("s_nationkey")),
        )
        .groupBy("s_nationkey")
        .agg(as_double(F.sum("units"), 4).alias("revenue"))
    )
    return (
        local.join(asia, col("s_nationkey") == col("n_nationkey"))
        .select("n_name", "revenue")
        .orderBy(col("revenue").desc(), "n_name")
    )


def q6(t: Tables) -> DataFrame:
    lines = t.lineitem.filter(
        within_year("l_shipdate", 1996)
        & col("l_discount").between(0.05, 0.07)
        & (col("l_quantity") < 24)
    )
    gain = hundredths("l_extendedprice") * hundredths("l_discount")
    return lines.agg(exact_sum(gain, 4).alias("revenue"))


def q7(t: Tables) -> DataFrame:
    pair = ["NATION_6", "NATION_7"]
    suppliers = t.supplier.join(
        nation_of(t, "supp").filter(col("supp_nation").isin(pair)),
        col("s_nationkey") == col("supp_nationkey"),
    ).select("s_suppkey", "supp_nation")
    customers = t.customer.join(
        nation_of(t, "cust").filter(col("cust_nation").isin(pair)),
        col("c_nationkey") == col("cust_nationkey"),
    ).select("c_custkey", "cust_nation")
    orders = (
        t.orders.select("o_orderkey", "o_custkey")
        .join(customers, col("o_custkey") == col("c_custkey"))
        .select("o_orderkey", "cust_nation")
    )
    return (
        t.lineitem.filter(both_years("l_shipdate"))
        .select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
        .join(suppliers, col("l_suppkey") == col("s_suppkey"))
        .join(orders, col("l_orderkey") == col("o_orderkey"))
        .filter(col("supp_nation") != col("cust_nation"))
        .groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year"))
        .agg(exact_sum(net_units(), 4).alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year")
    )


def q8(t: Tables) -> DataFrame:
    parts = t.part.filter(col("p_type") == "ECONOMY").select("p_partkey")
    customers = t.customer.join(
        nations_in(t, "AMERICA"), col("c_nationkey") == col("n_nationkey"), "left_semi"
    ).select("c_custkey")
    orders = (
        t.orders.filter(both_years("o_orderdate"))
        .select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
        .join(customers, col("o_custkey") == col("c_custkey"), "left_semi")
        .select("o_orderkey", "o_year")
    )
    per_supplier = (
        t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
        .join(parts, col("l_partkey") == col("p_partkey"), "left_semi")
        .join(orders, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_suppkey", "o_year")
        .agg(exact_total(net_units()).alias("units"))
    )
    ours = F.sum(F.when(col("supp_nation") == "NATION_1", col("units")).otherwise(F.lit(0)))
    return (
        per_supplier.join(
            t.supplier.select("s_suppkey", "s_nationkey"), col("l_suppkey") == col("s_suppkey")
        )
        .join(nation_of(t, "supp"), col("s_nationkey") == col("supp_nationkey"))
        .groupBy("o_year")
        .agg(as_double(ours, 4).alias("ours"), as_double(F.sum("units"), 4).alias("everyone"))
        .select("o_year", (col("ours") / col("everyone")).alias("mkt_share"))
        .orderBy("o_year")
    )


def q9(t: Tables) -> DataFrame:
    """Profit on red parts: sales less quantity times the pair's supply cost.

    Lines collapse to part, supplier and order year. A pair then has one row
    per year, so the lowest price of the pair is a window over a handful of
    rows, and lineitem is read once.
    """
    parts = t.part.filter(col("p_name").contains("red")).select("p_partkey")
    years = t.orders.select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    per_year = (
        t.lineitem.select("l_orderkey", *PAIR, "l_quantity", "l_extendedprice", "l_discount")
        .join(parts, col("l_partkey") == col("p_partkey"), "left_semi")
        .join(years, col("l_orderkey") == col("o_orderkey"), "left")
        .groupBy(*PAIR, "o_year")
        .agg(
            exact_total(net_units()).alias("sales"),
            F.sum(hundredths("l_quantity")).alias("quantity"),
            supply_cost_units().alias("lowest"),
        )
    )
    cost = F.min("lowest").over(Window.partitionBy(*PAIR)).cast("decimal(18,0)")
    # In 1/1,000,000: quantities count in hundredths.
    profit = col("sales") * F.lit(Decimal(100)) - col("cost") * col("quantity").cast("decimal(18,0)")
    per_supplier = (
        per_year.withColumn("cost", cost)
        .filter(col("o_year").isNotNull())
        .groupBy("l_suppkey", "o_year")
        .agg(F.sum(profit.cast("decimal(28,0)")).alias("units"))
    )
    return (
        per_supplier.join(
            t.supplier.select("s_suppkey", "s_nationkey"), col("l_suppkey") == col("s_suppkey")
        )
        .join(nation_of(t, "supp"), col("s_nationkey") == col("supp_nationkey"))
        .groupBy(col("supp_nation").alias("nation"), "o_year")
        .agg(as_double(F.sum("units"), 6).alias("sum_profit"))
        .orderBy("nation", col("o_year").desc())
    )


def q10(t: Tables) -> DataFrame:
    returned = (
        t.lineitem.filter(col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(exact_total(net_units()).alias("units"))
    )
    orders = t.orders.filter(within("o_orderdate", day(1995, 10, 1), day(1996, 1, 1))).select(
        "o_orderkey", "o_custkey"
    )
    top = (
        returned.join(orders, col("l_orderkey") == col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(as_double(F.sum("units"), 4).alias("revenue"))
        .orderBy(col("revenue").desc(), "o_custkey")
        .limit(20)
    )
    # Customer columns are fetched for the twenty winners only.
    return (
        top.join(t.customer, col("o_custkey") == col("c_custkey"))
        .join(nation_of(t, "cust"), col("c_nationkey") == col("cust_nationkey"))
        .select(
            "c_custkey", "c_name", "revenue", "c_acctbal", col("cust_nation").alias("n_name")
        )
        .orderBy(col("revenue").desc(), "c_custkey")
    )


def q11(t: Tables, fraction: float = 0.0001) -> DataFrame:
    """Parts whose stock at one nation's suppliers is worth over a fraction of it all."""
    suppliers = (
        t.supplier.join(
            nation_of(t, "supp").filter(col("supp_nation") == "NATION_7"),
            col("s_nationkey") == col("supp_nationkey"),
        ).select("s_suppkey")
    )
    lines = t.lineitem.select(*PAIR, "l_extendedprice", "l_quantity").join(
        suppliers, col("l_suppkey") == col("s_suppkey"), "left_semi"
    )
    pairs = group_after_join(
        lines,
        PAIR,
        supply_cost_units().cast("decimal(18,0)").alias("cost"),
        F.sum(hundredths("l_quantity")).cast("decimal(18,0)").alias("availqty"),
    )
    stock = pairs.groupBy(col("l_partkey").alias("ps_partkey")).agg(
        F.sum(col("cost") * col("availqty")).alias("units")
    )
    decimals = COST_DECIMALS + 2  # quantities count in hundredths
    total = stock.agg(as_double(F.sum("units"), decimals)).scalar()
    return (
        stock.select("ps_partkey", as_double(col("units"), decimals).alias("value"))
        .filter(col("value") > total * F.lit(fraction))
        .orderBy(col("value").desc(), "ps_partkey")
    )


def q12(t: Tables) -> DataFrame:
    """Return flag stands in for ship mode, ship after order for on-time commitments."""
    lines = t.lineitem.filter(
        col("l_returnflag").isin("A", "R") & within_year("l_shipdate", 1996)
    ).select("l_orderkey", "l_returnflag", "l_shipdate")
    urgent = col("o_orderpriority").isin(fx.URGENT_PRIORITIES)
    return (
        lines.join(
            t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"),
            (col("l_orderkey") == col("o_orderkey")) & (col("l_shipdate") > col("o_orderdate")),
        )
        .groupBy("l_returnflag")
        .agg(
            F.count_if(urgent).alias("high_line_count"),
            F.count_if(~urgent).alias("low_line_count"),
        )
        .orderBy("l_returnflag")
    )


def q13(t: Tables) -> DataFrame:
    """Priority text stands in for the order comment."""
    per_customer = (
        t.orders.filter(~col("o_orderpriority").rlike("NOT.*SPEC"))
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return (
        t.customer.select("c_custkey")
        .join(per_customer, col("c_custkey") == col("o_custkey"), "left")
        .groupBy(F.coalesce("orders", F.lit(0)).alias("c_count"))
        .agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(col("custdist").desc(), col("c_count").desc())
    )


def q14(t: Tables) -> DataFrame:
    per_part = (
        t.lineitem.filter(within("l_shipdate", day(1995, 9, 1), day(1995, 10, 1)))
        .groupBy("l_partkey")
        .agg(exact_total(net_units()).alias("units"))
    )
    promo = F.when(col("p_type").startswith("PROMO"), col("units")).otherwise(F.lit(0))
    return (
        per_part.join(t.part.select("p_partkey", "p_type"), col("l_partkey") == col("p_partkey"))
        .agg(as_double(F.sum(promo), 4).alias("promo"), as_double(F.sum("units"), 4).alias("all"))
        .select((F.lit(100.0) * col("promo") / col("all")).alias("promo_revenue"))
    )


def q15(t: Tables) -> DataFrame:
    revenue = (
        t.lineitem.filter(within("l_shipdate", day(1996, 1, 1), day(1996, 4, 1)))
        # Stated so that the maximum below reads the same shuffle as the join.
        .filter(col("l_suppkey").isNotNull())
        .groupBy("l_suppkey")
        .agg(exact_sum(net_units(), 4).alias("total_revenue"))
    )
    best = revenue.agg(F.max("total_revenue")).scalar()
    return (
        revenue.filter(col("total_revenue") == best)
        .join(t.supplier.select("s_suppkey", "s_name"), col("l_suppkey") == col("s_suppkey"))
        .select("s_suppkey", "s_name", "total_revenue")
        .orderBy("s_suppkey")
    )


def q16(t: Tables) -> DataFrame:
    """A negative balance stands in for a complaint on record."""
    parts = t.part.filter(
        (col("p_brand") != "Brand#45")
        & ~col("p_type").startswith("MEDIUM")
        & col("p_size").isin(fx.Q16_SIZES)
    ).select("p_partkey", "p_brand", "p_type", "p_size")
    complaints = t.supplier.filter(col("s_acctbal") < 0).select("s_suppkey")
    return (
        t.lineitem.select("l_partkey", "l_suppkey")
        .join(complaints, col("l_suppkey") == col("s_suppkey"), "left_anti")
        .join(parts, col("l_partkey") == col("p_partkey"))
        .groupBy("p_brand", "p_type", "p_size")
        .agg(F.count_distinct("l_suppkey").alias("supplier_cnt"))
        .orderBy(col("supplier_cnt").desc(), "p_brand", "p_type", "p_size")
    )


def q17(t: Tables) -> DataFrame:
    """Lines below a fifth of their part's average quantity.

    Whether a line counts depends only on its part and quantity, so lines are
    first collapsed to those two. A part then has as many rows as it has
    distinct quantities, and a window over those finds its average without a
    second pass over lineitem.
    """
    parts = t.part.filter(col("p_brand") == "Brand#23").select("p_partkey")
    lines = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice").join(
        parts, col("l_partkey") == col("p_partkey"), "left_semi"
    )
    by_quantity = group_after_join(
        lines,
        ["l_partkey", "l_quantity"],
        F.count(F.lit(1)).alias("lines"),
        exact_total(hundredths("l_extendedprice")).alias("units"),
    )
    part = Window.partitionBy("l_partkey")
    average = F.sum(col("l_quantity") * col("lines")).over(part) / F.sum("lines").over(part)
    return (
        by_quantity.withColumn("avg_quantity", average)
        .filter(col("l_quantity") < F.lit(0.2) * col("avg_quantity"))
        .agg((as_double(F.sum("units"), 2) / 7.0).alias("avg_yearly"))
    )


def q18(t: Tables) -> DataFrame:
    large = (
        t.lineitem.groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("total_quantity"))
        .filter(col("total_quantity") > 300)
    )
    top = (
        large.join(
            t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"),
            col("l_orderkey") == col("o_orderkey"),
        )
        .orderBy(col("o_totalprice").desc(), "o_orderdate", "o_orderkey")
        .limit(100)
    )
    return (
        top.join(t.customer.select("c_custkey", "c_name"), col("o_custkey") == col("c_custkey"))
        .select(
            "c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "total_quantity"
        )
        .orderBy(col("o_totalprice").desc(), "o_orderdate", "o_orderkey")
    )


# FIXED VALUES: brand, quantity range and largest size of each branch (no containers here).
Q19_BRANCHES = [("Brand#12", (1, 11), 5), ("Brand#23", (10, 20), 10), ("Brand#14", (20, 30), 15)]


def q19(t: Tables) -> DataFrame:
    """The brand picks the branch, so each part carries its own quantity range."""
    low = high = F.lit(None).cast("double")
    wanted = F.lit(False)
    for brand, (from_qty, to_qty), max_size in Q19_BRANCHES:
        is_brand = col("p_brand") == brand
        wanted = wanted | (is_brand & col("p_size").between(1, max_size))
        low = F.when(is_brand, F.lit(float(from_qty))).otherwise(low)
        high = F.when(is_brand, F.lit(float(to_qty))).otherwise(high)
    parts = t.part.filter(wanted).select("p_partkey", low.alias("low"), high.alias("high"))
    widest = F.lit(float(max(b[1][1] for b in Q19_BRANCHES)))
    return (
        t.lineitem.filter(col("l_quantity") <= widest)
        .select("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
        .join(
            parts,
            (col("l_partkey") == col("p_partkey")) & col("l_quantity").between(col("low"), col("high")),
        )
        .agg(exact_sum(net_units(), 4).alias("revenue"))
    )


def q20(t: Tables) -> DataFrame:
    """Suppliers that shipped over half of a red part's availability within a year."""
    parts = t.part.filter(col("p_name").startswith("red")).select("p_partkey")
    suppliers = (
        t.supplier.join(
            nation_of(t, "supp").filter(col("supp_nation") == "NATION_9"),
            col("s_nationkey") == col("supp_nationkey"),
        ).select("s_suppkey", "s_name")
    )
    in_year = F.when(within_year("l_shipdate", 1996), col("l_quantity")).otherwise(F.lit(0.0))
    # Shipped and available quantity of a pair in one pass.
    lines = (
        t.lineitem.select(*PAIR, "l_quantity", "l_shipdate")
        .join(parts, col("l_partkey") == col("p_partkey"), "left_semi")
        .join(suppliers.select("s_suppkey"), col("l_suppkey") == col("s_suppkey"), "left_semi")
    )
    keepers = (
        group_after_join(
            lines, PAIR, F.sum(in_year).alias("shipped"), F.sum("l_quantity").alias("available")
        )
        .filter(col("shipped") > F.lit(0.5) * col("available"))
        .select("l_suppkey")
        .distinct()
    )
    return (
        suppliers.join(keepers, col("s_suppkey") == col("l_suppkey"), "left_semi")
        .select("s_suppkey", "s_name")
        .orderBy("s_name", "s_suppkey")
    )


def q21(t: Tables) -> DataFrame:
    """Suppliers that alone kept a multi-supplier order waiting.

    Per order, the smallest and largest supplier key say whether there is more
    than one supplier, and the same over its late lines says whether exactly
    one of them is late. That replaces EXISTS and NOT EXISTS self joins.
    """
    orders = t.orders.filter(col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate")
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate").join(
        orders, col("l_orderkey") == col("o_orderkey")
    )
    late_supplier = F.when(late_line(), col("l_suppkey"))
    per_order = group_after_join(
        lines,
        ["l_orderkey"],
        F.min("l_suppkey").alias("first_supplier"),
        F.max("l_suppkey").alias("last_supplier"),
        F.min(late_supplier).alias("l_suppkey"),
        F.max(late_supplier).alias("other_late"),
        F.count_if(late_line()).alias("late_lines"),
    )
    waiting = (
        per_order
        .filter(
            (col("first_supplier") != col("last_supplier"))
            & (col("l_suppkey") == col("other_late"))
        )
        .groupBy("l_suppkey")
        .agg(F.sum("late_lines").alias("numwait"))
    )
    return (
        waiting.join(t.supplier.select("s_suppkey", "s_name"), col("l_suppkey") == col("s_suppkey"))
        .groupBy("s_name")
        .agg(F.sum("numwait").alias("numwait"))
        .orderBy(col("numwait").desc(), "s_name")
        .limit(100)
    )


def q22(t: Tables) -> DataFrame:
    """Nation keys stand in for phone prefixes, no order since 2000 for no order at all."""
    customers = t.customer.filter(col("c_nationkey").isin(1, 2, 3, 5, 7, 11, 13)).select(
        "c_custkey", "c_nationkey", "c_acctbal"
    )
    average = (
        customers.filter(col("c_acctbal") > 0)
        .agg(exact_sum(hundredths("c_acctbal"), 2) / F.count(F.lit(1)))
        .scalar()
    )
    recent = t.orders.filter(col("o_orderdate") >= day(2000, 1, 1)).select("o_custkey").distinct()
    return (
        customers.filter(col("c_acctbal") > average)
        .join(recent, col("c_custkey") == col("o_custkey"), "left_anti")
        .groupBy(F.lpad(col("c_nationkey").cast("string"), 2, "0").alias("cntrycode"))
        .agg(
            F.count(F.lit(1)).alias("numcust"),
            exact_sum(hundredths("c_acctbal"), 2).alias("totacctbal"),
        )
        .orderBy("cntrycode")
    )


RELATIONAL = {
    f"tpch_q{number}": query
    for number, query in enumerate(
        (q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11,
         q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22),
        start=1,
    )
}


def queries() -> dict[str, Query]:
    def bind(plan: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: plan(Tables(spark, sf_dir))

    return {name: bind(plan) for name, plan in RELATIONAL.items()}
