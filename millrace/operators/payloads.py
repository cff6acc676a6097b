"""Numeric kernels and payload-shape experiments, each one native projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import black_scholes_terms, norm_cdf
from .row_kernels import overhead

col = F.col


def add(df: DataFrame) -> DataFrame:
    return df.select((col("a") + col("b")).alias("result"), overhead())


def normal_cdf(df: DataFrame) -> DataFrame:
    return df.select(col("v").alias("input_val"), norm_cdf(col("v")).alias("cdf_result"), overhead())


def call_price(df: DataFrame) -> DataFrame:
    """European call by Black and Scholes."""
    spot, strike, expiry = col("spot"), col("strike"), col("time_to_exp")
    rate, volatility = col("risk_free"), col("volatility")
    upper, lower = black_scholes_terms(spot, strike, expiry, rate, volatility)
    # d1 and d2 feed long polynomials, so they are columns of their own first.
    terms = df.select(
        spot,
        (strike * F.exp(-rate * expiry)).alias("present_strike"),
        upper.alias("d1"),
        lower.alias("d2"),
    )
    price = spot * norm_cdf(col("d1")) - col("present_strike") * norm_cdf(col("d2"))
    return terms.select(price.alias("call_price"), overhead())


def two_sums(df: DataFrame) -> DataFrame:
    return df.select((col("a") + col("b")).alias("r1"), (col("c") + col("d")).alias("r2"), overhead())


def sum_and_string(df: DataFrame) -> DataFrame:
    total = col("a") + col("b") + col("c")
    return df.select(col("s_in").alias("s_out"), total.alias("r1"), overhead())


def pass_strings(df: DataFrame) -> DataFrame:
    """Every ``s_in`` column comes out under the matching ``s_out`` name."""
    renamed = [
        col(c).alias(c.replace("s_in", "s_out", 1)) for c in df.columns if c.startswith("s_in")
    ]
    return df.select(*renamed, overhead())
