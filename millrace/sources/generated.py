"""Deterministic wide tables derived from a row sequence.

Every column is a closed-form function of ``id`` so that any number of
executors can build any slice of the table without coordination, and Catalyst
prunes the columns a query does not use. Scaled values are written as one
division of two integers: the quotient is the double nearest to the decimal
value, which is what a decimal computation followed by a cast would give, at a
fraction of its cost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fx


@dataclass(frozen=True)
class Cycle:
    """Column builders over the sequence 0..rows-1."""

    rows: int

    @property
    def id(self) -> Column:
        return F.col("id")

    def mod(self, length: int, shift: int = 0, step: int = 1) -> Column:
        position = self.id if step == 1 else self.id * step
        return (position + shift if shift else position) % length

    def pick(self, values: list[str], shift: int = 0) -> Column:
        words = F.array(*[F.lit(v) for v in values])
        return F.element_at(words, (self.mod(len(values), shift) + 1).cast("int"))

    def scaled(self, first: int, length: int, unit: int, step: int = 1) -> Column:
        """(first + step * (id mod length)) / unit."""
        return (F.lit(first) + self.mod(length) * step) / F.lit(unit)

    def day(self, shift: int = 0, step: int = 1) -> Column:
        return (self.mod(fx.CALENDAR_DAYS, shift, step) + fx.CALENDAR_START).cast("int")

    def key(self, rows_per_key: int, at_least: int) -> Column:
        return self.mod(max(self.rows // rows_per_key, at_least))

    def flag(self, condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    # Columns that several tables share.
    @property
    def quantity(self) -> Column:
        return (self.mod(50) + 1).cast("double")

    @property
    def price(self) -> Column:
        return self.scaled(90_000, 99_000, 100)

    @property
    def discount(self) -> Column:
        return self.scaled(0, 11, 100)

    @property
    def supply_cost(self) -> Column:
        return self.scaled(100, 1_000, 100)

    @property
    def size(self) -> Column:
        return (self.mod(50) + 1).cast("int")

    def label(self, prefix: str, key: Column, suffix: str = "") -> Column:
        parts = [F.lit(prefix), key.cast("string")]
        return F.concat(*parts, F.lit(suffix)) if suffix else F.concat(*parts)


Recipe = Callable[[Cycle], dict[str, Column]]


def _q2(c: Cycle) -> dict[str, Column]:
    return {
        "l_rowid": c.id,
        "p_partkey": c.mod(200_000),
        "p_size": c.size,
        "p_type": c.pick(fx.PART_TYPES),
        "p_mfgr": c.label("Manufacturer#", c.mod(5) + 1),
        "s_name": c.label("Supplier#", c.key(100, 100)),
        "s_nation": c.pick(fx.NATIONS),
        # Five consecutive nations share a region here, whatever their real region is.
        "s_region": F.element_at(
            F.array(*[F.lit(r) for r in fx.REGIONS]), F.floor(c.mod(25) / 5).cast("int") + 1
        ),
        "ps_supplycost": c.supply_cost,
    }


# One recipe per generated input; the key is the kernel that reads it.
WIDE_TABLES: dict[str, Recipe] = {
    "tpch_q1": lambda c: {
        "l_rowid": c.id,
        "l_quantity": c.quantity,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "l_tax": c.scaled(0, 9, 100),
        "l_returnflag": c.pick(fx.RETURN_FLAGS),
        "l_linestatus": c.pick(fx.LINE_STATUS),
        "l_shipdate_days": c.day(),
    },
    "tpch_q2": _q2,
    "tpch_q3": lambda c: {
        "l_rowid": c.id,
        "l_orderkey": c.key(4, 1000),
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "l_shipdate_days": c.day(),
        "o_orderdate_days": c.day(step=3),
        "c_mktsegment": c.pick(fx.SEGMENTS),
        "o_shippriority": c.mod(3),
    },
    "tpch_q4": lambda c: {
        "l_rowid": c.id,
        "o_orderpriority": c.pick(fx.ORDER_PRIORITIES),
        "o_orderdate_days": c.day(step=3),
        "l_commitdate_days": c.day(30),
        "l_receiptdate_days": c.day(60),
    },
    "tpch_q5": lambda c: {
        "l_rowid": c.id,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "c_nation": c.pick(fx.NATIONS),
        "s_nation": c.pick(fx.NATIONS, 3),
        "r_name": c.pick(fx.REGIONS),
        "o_orderdate_days": c.day(step=3),
    },
    "tpch_q6": lambda c: {
        "l_rowid": c.id,
        "l_quantity": c.quantity,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "l_shipdate_days": c.day(),
    },
    "tpch_q7": lambda c: {
        "l_rowid": c.id,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "s_nation": c.pick(fx.NATIONS),
        "c_nation": c.pick(fx.NATIONS, 7),
        "l_shipdate_days": c.day(),
    },
    "tpch_q8": lambda c: {
        "l_rowid": c.id,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "s_nation": c.pick(fx.NATIONS),
        "c_region": c.pick(fx.REGIONS),
        "p_type": c.pick(fx.PART_TYPES),
        "o_orderdate_days": c.day(step=3),
    },
    "tpch_q9": lambda c: {
        "l_rowid": c.id,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "l_quantity": c.quantity,
        "ps_supplycost": c.supply_cost,
        "s_nation": c.pick(fx.NATIONS),
        "p_name": F.concat(F.lit("part_"), c.pick(fx.PART_COLORS)),
        "o_orderdate_days": c.day(step=3),
    },
    "tpch_q10": lambda c: {
        "l_rowid": c.id,
        "c_custkey": c.key(10, 1000),
        "c_name": c.label("Customer#", c.key(10, 1000)),
        "c_nation": c.pick(fx.NATIONS),
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "l_returnflag": c.pick(fx.RETURN_FLAGS),
        "o_orderdate_days": c.day(step=3),
    },
    "tpch_q11": lambda c: {
        "l_rowid": c.id,
        "ps_partkey": c.mod(200_000),
        "ps_supplycost": c.supply_cost,
        "ps_availqty": c.mod(9999) + 1,
        "s_nation": c.pick(fx.NATIONS),
    },
    "tpch_q12": lambda c: {
        "l_rowid": c.id,
        "l_shipmode": c.pick(fx.SHIP_MODES),
        "o_orderpriority": c.pick(fx.ORDER_PRIORITIES),
        "l_shipdate_days": c.day(),
        "l_commitdate_days": c.day(30),
        "l_receiptdate_days": c.day(60),
    },
    "tpch_q13": lambda c: {
        "l_rowid": c.id,
        "c_custkey": c.key(10, 1000),
        "o_comment": c.pick(fx.ORDER_COMMENTS),
    },
    "tpch_q14": lambda c: {
        "l_rowid": c.id,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "p_type": c.pick(fx.PROMO_QUERY_TYPES),
        "l_shipdate_days": c.day(),
    },
    "tpch_q15": lambda c: {
        "l_rowid": c.id,
        "l_suppkey": c.key(600, 100),
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "l_shipdate_days": c.day(),
    },
    "tpch_q16": lambda c: {
        "l_rowid": c.id,
        "p_brand": c.pick(fx.BRANDS),
        "p_type": c.pick(fx.PART_TYPES),
        "p_size": c.size,
        "ps_suppkey": c.key(600, 100),
        "is_complaint": c.flag(c.mod(100) == 0),
    },
    "tpch_q17": lambda c: {
        "l_rowid": c.id,
        "p_brand": c.pick(fx.BRANDS),
        "p_container": c.pick(fx.CONTAINERS),
        "l_quantity": c.quantity,
        "l_extendedprice": c.price,
        "avg_quantity": (c.mod(10) + 20).cast("double"),
    },
    "tpch_q18": lambda c: {
        "l_rowid": c.id,
        "c_name": c.label("Customer#", c.key(10, 1000)),
        "c_custkey": c.key(10, 1000),
        "o_orderkey": c.key(4, 1000),
        "o_totalprice": c.scaled(1_000_000, 990_000, 100),
        "l_quantity": c.quantity,
        "order_total_qty": F.when(c.mod(20) == 0, c.mod(100) + 310)
        .otherwise(c.mod(200) + 50)
        .cast("double"),
    },
    "tpch_q19": lambda c: {
        "l_rowid": c.id,
        "l_extendedprice": c.price,
        "l_discount": c.discount,
        "l_quantity": c.quantity,
        "l_shipmode": c.pick(fx.SHIP_MODES),
        "l_shipinstruct": c.pick(fx.SHIP_INSTRUCTS),
        "p_brand": c.pick(fx.BRANDS),
        "p_container": c.pick(fx.CONTAINERS),
        "p_size": c.size,
    },
    "tpch_q20": lambda c: {
        "l_rowid": c.id,
        "s_name": c.label("Supplier#", c.key(600, 100)),
        "s_address": c.label("addr_", c.key(600, 100)),
        "s_nation": c.pick(fx.NATIONS),
        "p_name": F.concat(c.pick(fx.PART_COLORS), F.lit(" part")),
        "l_quantity": c.quantity,
        "ps_availqty": (c.mod(9900) + 100).cast("double"),
        "shipped_qty": F.when(c.mod(5) == 0, c.mod(50) + 80)
        .otherwise(c.mod(30) + 10)
        .cast("double"),
        "l_shipdate_days": c.day(),
    },
    "tpch_q21": lambda c: {
        "l_rowid": c.id,
        "s_name": c.label("Supplier#", c.key(600, 100)),
        "s_nation": c.pick(fx.NATIONS),
        "o_orderstatus": c.pick(fx.ORDER_STATUS),
        "l_receiptdate_days": c.day(60),
        "l_commitdate_days": c.day(30),
        "has_other_supplier": c.flag(c.mod(3) == 0),
        "other_also_late": c.flag(c.mod(7) == 0),
    },
    "tpch_q22": lambda c: {
        "l_rowid": c.id,
        # The last listed code is never reached: the cycle is one shorter than the list.
        "cntrycode": c.pick((fx.SALES_CODES + fx.OTHER_CODES)[:14]),
        "c_acctbal": c.scaled(-5_000, 15_000, 10),
        "has_orders": c.flag(c.mod(10) >= 3),
        "avg_acctbal": F.lit(500.0),
    },
    "add": lambda c: {"row_id": c.id, "a": c.id, "b": c.id * 7 + 3},
    "norm_cdf": lambda c: {"row_id": c.id, "v": F.lit(-4.0) + F.lit(8.0) * c.id / F.lit(c.rows)},
    "options": lambda c: {
        "row_id": c.id,
        "spot": (c.mod(40) + 80).cast("double"),
        "strike": F.lit(100.0),
        "time_to_exp": c.scaled(50, 20, 100, step=5),
        "risk_free": F.lit(0.05),
        "volatility": c.scaled(15, 10, 100, step=3),
    },
    "str0": lambda c: {
        "row_id": c.id,
        "a": c.id * 11 / 10,
        "b": c.id * 22 / 10,
        "c": c.id * 33 / 10,
        "d": c.id * 44 / 10,
    },
    "str2": lambda c: {
        "row_id": c.id,
        "a": c.id * 11 / 10,
        "b": c.id * 22 / 10,
        "c": c.id * 33 / 10,
        "s_in": c.label("value_", c.mod(1000)),
    },
    "str4": lambda c: {
        "row_id": c.id,
        "a": c.id * 11 / 10,
        "s_in1": c.label("name_", c.mod(1000)),
        "s_in2": c.label("city_", c.mod(500)),
    },
    "str6": lambda c: {
        "row_id": c.id,
        "s_in1": c.label("supplier_", c.mod(1000)),
        "s_in2": c.label("nation_", c.mod(25)),
        "s_in3": c.label("region_", c.mod(5)),
    },
    "str8": lambda c: {
        "row_id": c.id,
        "s_in1": c.label("supplier_", c.mod(1000)),
        "s_in2": c.label("nation_", c.mod(25)),
        "s_in3": c.label("region_", c.mod(5)),
        "s_in4": c.label("brand_", c.mod(100)),
    },
    "str16": lambda c: {
        "row_id": c.id,
        **{
            f"s_in{i}": c.label(f"s{i}_", c.mod(length))
            for i, length in enumerate((1000, 25, 5, 100, 500, 200, 10, 150), start=1)
        },
    },
    "len_short": lambda c: {"row_id": c.id, "s_in": c.mod(99_999).cast("string")},
    "len_medium": lambda c: {"row_id": c.id, "s_in": c.label("Supplier#", c.mod(99_999), "_name")},
    "len_long": lambda c: {
        "row_id": c.id,
        "s_in": c.label(
            "This_is_a_long_supplier_name_for_testing_Supplier#",
            c.mod(99_999),
            "_located_in_region_EUROPE_nation",
        ),
    },
}


def wide_table(
    spark: SparkSession, name: str, rows: int, parallelism: int | None = None
) -> DataFrame:
    """The generated input ``name`` with ``rows`` rows in ``parallelism`` partitions."""
    columns = WIDE_TABLES[name](Cycle(rows))
    return spark.range(0, rows, 1, parallelism).select(
        *[expr.alias(column) for column, expr in columns.items()]
    )


# --- auction stream -------------------------------------------------------

def person_count(rows: int, person_ratio: int = 10) -> int:
    return max(rows // person_ratio, 1000)


def clock_step_ms(rows: int) -> int:
    """Events are spread over a minute, at least one millisecond apart."""
    return max(60_000 // rows, 1) if rows else 1


def auction_persons(
    spark: SparkSession, persons: int, parallelism: int | None = None
) -> DataFrame:
    c = Cycle(persons)
    return spark.range(0, persons, 1, parallelism).select(
        c.id.alias("p_id"),
        c.label("person_", c.id).alias("name"),
        c.label("city_", c.mod(1000)).alias("city"),
        c.pick(fx.US_STATES).alias("state"),
        (c.id * clock_step_ms(persons)).alias("p_date_time"),
    )


def auctions(
    spark: SparkSession, rows: int, persons: int, parallelism: int | None = None
) -> DataFrame:
    c = Cycle(rows)
    return spark.range(0, rows, 1, parallelism).select(
        c.id.alias("a_id"),
        c.mod(persons).alias("seller"),
        c.mod(20).cast("int").alias("category"),
        (c.id * clock_step_ms(rows)).alias("a_date_time"),
    )


def bids(spark: SparkSession, rows: int, parallelism: int | None = None) -> DataFrame:
    """Half of the bids go to the one percent of auctions that are hot."""
    c = Cycle(rows)
    n_auctions = max(rows // 100, 1000)
    n_hot = max(n_auctions // 100, 1)
    n_cold = max(n_auctions - n_hot, 1)
    return spark.range(0, rows, 1, parallelism).select(
        c.id.alias("bid_id"),
        F.when(c.mod(2) == 0, c.mod(n_hot)).otherwise(c.mod(n_cold) + n_hot).alias("auction"),
        (c.id * clock_step_ms(rows)).alias("date_time"),
    )
