"""Row, numeric and payload kernels over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import payloads
from ..operators.row_kernels import KERNELS
from . import row_inputs
from .auction_inputs import auctions, bids, persons

col = F.col
Query = Callable[[SparkSession, str], DataFrame]


def _rows(name: str) -> Query:
    kernel = partial(KERNELS[name], words=row_inputs.COMMENT_WORDS) if name == "tpch_q13" else KERNELS[name]
    if name in row_inputs.MEETS:
        return lambda spark, sf_dir: row_inputs.kernel_rows(spark, sf_dir, name, kernel)
    return lambda spark, sf_dir: kernel(row_inputs.row_input(spark, sf_dir, name))


def kernel_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return row_inputs.KERNEL_INPUTS[name](spark, sf_dir)


def _over(input_name: str, transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: transform(kernel_input(spark, sf_dir, input_name))


def _rounded(transform: Callable[[DataFrame], DataFrame], column: str) -> Callable:
    """exp and log differ in the last bit between math libraries: compare eight decimals."""

    def rounded(df: DataFrame) -> DataFrame:
        return transform(df).withColumn(column, F.round(column, 8))

    return rounded


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the pricing kernel, as they are."""
    return row_inputs.lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate_days",
    )


#: Of the wide table, a column of every table and all that is not in the given ones.
WIDE_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipmode", "o_orderstatus", "c_name", "c_nation", "s_name", "s_nation", "s_address",
    "is_complaint", "p_type", "p_name", "p_container", "ps_supplycost", "avg_quantity", "ps_availqty", "shipped_qty", "order_total_qty",
    "has_other_supplier", "other_also_late",
)


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_inputs.met_rows(spark, sf_dir, "src_wide_rows").select(*WIDE_COLUMNS)


def queries() -> dict[str, Query]:
    return {
        "src_wide_rows": wide_lines,
        "src_lineitem_gen": priced_lines,
        "src_options_gen": row_inputs.options,
        "src_nexmark_persons": persons,
        "src_nexmark_auctions": auctions,
        "src_nexmark_bids": bids,
        **{f"rows_{name}": _rows(name) for name in KERNELS},
        "k_add": _over("add", payloads.add),
        "k_norm_cdf": _over("norm_cdf", _rounded(payloads.normal_cdf, "cdf_result")),
        "k_black_scholes": _over("options", _rounded(payloads.call_price, "call_price")),
        "x_str0": _over("str0", payloads.two_sums),
        "x_str2": _over("str2", payloads.sum_and_string),
        **{
            f"x_{name}": _over(name, payloads.pass_strings)
            for name in ("str4", "str6", "str8", "str16", "len_short", "len_medium", "len_long")
        },
    }
