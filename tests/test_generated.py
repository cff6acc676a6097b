"""Generated tables: known hit counts, NULL handling and plan shape."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import payloads
from millrace.operators.row_kernels import KERNELS
from millrace.plans import generated as plans
from millrace.plans import nexmark
from millrace.sources import generated as gen

N = 60_000
# Rows that pass at 60,000 rows, and at 1,000,000.
HITS = {
    "tpch_q1": (57_263, 953_471),
    "tpch_q2": (0, 0),
    "tpch_q3": (2_134, 36_129),
    "tpch_q5": (0, 0),
    "tpch_q7": (0, 0),
    "tpch_q8": (140, 2_348),
    "tpch_q9": (652, 10_870),
    "tpch_q10": (710, 11_740),
    "tpch_q11": (2_400, 40_000),
    "tpch_q12": (2_502, 40_775),
    "tpch_q15": (2_093, 35_581),
    "tpch_q16": (7_900, 131_668),
    "tpch_q17": (0, 0),
    "tpch_q18": (3_000, 50_000),
    "tpch_q20": (0, 0),
    "tpch_q21": (0, 0),
    "tpch_q22": (3_142, 51_819),
}


def run(spark, name, rows):
    return KERNELS[name](gen.wide_table(spark, name, rows))


@pytest.mark.parametrize("name", sorted(HITS))
@pytest.mark.parametrize("size", [0, 1])
def test_hits(spark, name, size):
    rows = (N, 1_000_000)[size]
    result = run(spark, name, rows).agg(F.count(F.lit(1)), F.sum("passed_filter")).first()
    assert tuple(result) == (rows, HITS[name][size])


def count_if(df, condition):
    return df.filter(condition).count()


def test_hits_of_kernels_with_other_flags(spark):
    q4 = run(spark, "tpch_q4", N)
    assert count_if(q4, "in_range = 1") == 2_130
    assert count_if(q4, "is_late = 1") == 59_310
    assert count_if(q4, "is_late = 1 AND in_range = 1") == 2_130
    assert count_if(run(spark, "tpch_q6", N), "revenue_part > 0") == 1_093
    assert count_if(run(spark, "tpch_q8", N), "nation_volume > 0") == 0
    assert count_if(run(spark, "tpch_q13", N), "is_valid = 1") == 37_500
    q14 = run(spark, "tpch_q14", N)
    assert count_if(q14, "total_value > 0") == 690
    assert count_if(q14, "promo_value > 0") == 207
    assert count_if(run(spark, "tpch_q19", N), "revenue_part > 0") == 0


def test_branches_no_generated_row_reaches(spark):
    """Predicates whose generated columns conflict, on rows that satisfy them."""
    line = "SELECT 100.0D AS l_extendedprice, 0.1D AS l_discount, "
    q2 = spark.sql(
        "SELECT 's' AS s_name, 'FRANCE' AS s_nation, 1L AS p_partkey, 2.0D AS ps_supplycost, "
        "'EUROPE' AS s_region, 15 AS p_size, 'SMALL BRASS' AS p_type"
    )
    assert KERNELS["tpch_q2"](q2).first().passed_filter == 1
    q5 = spark.sql(line + "'INDIA' AS c_nation, 'INDIA' AS s_nation, 'ASIA' AS r_name, 8766 AS o_orderdate_days")
    assert KERNELS["tpch_q5"](q5).first().revenue == 90.0
    q7 = spark.sql(line + "'FRANCE' AS s_nation, 'GERMANY' AS c_nation, 9131 AS l_shipdate_days")
    row = KERNELS["tpch_q7"](q7).first()
    assert (row.supp_nation, row.cust_nation, row.l_year, row.volume) == ("FRANCE", "GERMANY", 1995, 90.0)
    q8 = spark.sql(
        line + "'BRAZIL' AS s_nation, 'AMERICA' AS c_region, 'ECONOMY ANODIZED STEEL' AS p_type, "
        "9861 AS o_orderdate_days"
    )
    row = KERNELS["tpch_q8"](q8).first()
    # 1996-12-31 counts as 1997: kernel years have 365 days.
    assert (row.nation_volume, row.o_year) == (90.0, 1997)
    q17 = spark.sql(
        "SELECT 70.0D AS l_extendedprice, 'Brand#23' AS p_brand, 'MED BOX' AS p_container, "
        "1.0D AS l_quantity, 20.0D AS avg_quantity"
    )
    assert KERNELS["tpch_q17"](q17).first().revenue_part == 70.0
    for brand, container, quantity, size in (
        ("Brand#12", "SM BOX", 11.0, 5),
        ("Brand#23", "MED PKG", 20.0, 10),
        ("Brand#34", "LG PACK", 30.0, 15),
    ):
        q19 = line + (
            f"'AIR' AS l_shipmode, 'DELIVER IN PERSON' AS l_shipinstruct, '{brand}' AS p_brand, "
            f"'{container}' AS p_container, {{}}D AS l_quantity, {size} AS p_size"
        )
        assert KERNELS["tpch_q19"](spark.sql(q19.format(quantity))).first().revenue_part == 90.0
        assert KERNELS["tpch_q19"](spark.sql(q19.format(quantity + 1))).first().revenue_part == 0.0
    q20 = spark.sql(
        "SELECT 's' AS s_name, 'a' AS s_address, 'CANADA' AS s_nation, 'forest part' AS p_name, "
        "9130 AS l_shipdate_days, 51.0D AS shipped_qty, 100.0D AS ps_availqty"
    )
    assert KERNELS["tpch_q20"](q20).first().passed_filter == 1
    q21 = spark.sql(
        "SELECT 's' AS s_name, 'SAUDI ARABIA' AS s_nation, 'F' AS o_orderstatus, 2 AS l_receiptdate_days, "
        "1 AS l_commitdate_days, 1 AS has_other_supplier, 0 AS other_also_late"
    )
    assert KERNELS["tpch_q21"](q21).first().numwait == 1


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_null_inputs_fail_the_predicate(spark, name):
    source = gen.wide_table(spark, name, 1)
    nulls = source.select(*[F.lit(None).cast(t).alias(c) for c, t in source.dtypes])
    row = KERNELS[name](nulls).first().asDict()
    for flag in ("passed_filter", "is_late", "in_range", "is_valid", "high_line", "low_line"):
        assert row.get(flag, 0) == 0
    assert row["overhead"] == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kernels_are_one_native_projection(spark):
    for name, kernel in KERNELS.items():
        plan = plan_of(kernel(gen.wide_table(spark, name, N)))
        assert "Python" not in plan and "Exchange" not in plan, name


def test_partitions_follow_the_argument(spark):
    assert gen.wide_table(spark, "add", 100, parallelism=3).rdd.getNumPartitions() == 3


def test_call_price_against_the_closed_form(spark):
    from math import erf, exp, log, sqrt

    def phi(x):
        return (1 + erf(x / sqrt(2))) / 2

    rows = gen.wide_table(spark, "options", 400).collect()
    prices = payloads.call_price(gen.wide_table(spark, "options", 400)).collect()
    for option, price in zip(rows, prices):
        spread = option.volatility * sqrt(option.time_to_exp)
        drift = (option.risk_free + option.volatility**2 / 2) * option.time_to_exp
        d1 = (log(option.spot / option.strike) + drift) / spread
        held = option.strike * exp(-option.risk_free * option.time_to_exp)
        assert abs(price.call_price - (option.spot * phi(d1) - held * phi(d1 - spread))) < 5e-5


def test_cdf_is_symmetric_and_monotone(spark):
    rows = payloads.normal_cdf(gen.wide_table(spark, "norm_cdf", 1001)).collect()
    values = [r.cdf_result for r in rows]
    assert values == sorted(values)
    assert abs(values[0]) < 1e-4 and abs(values[500] + values[501] - 1) < 0.01


@pytest.fixture(scope="module")
def auction_tables(spark):
    persons = gen.person_count(N)
    return gen.auction_persons(spark, persons), gen.auctions(spark, N, persons), gen.bids(spark, N)


def test_auction_stream_counts(spark, auction_tables):
    persons, auctions, bids = auction_tables
    q3 = nexmark.local_sellers(auctions, persons, keep_unmatched=True)
    assert (q3.count(), count_if(q3, "auction_id IS NOT NULL")) == (N, 600)
    assert nexmark.local_sellers(auctions, persons).count() == 600
    q5 = nexmark.hot_bids(bids, "10 seconds", "2 seconds")
    assert (q5.count(), count_if(q5, "num = 1000")) == (N, 30_000)
    assert count_if(q5, "num IS NOT NULL") == 30_000
    hot = nexmark.hot_auctions(bids, "10 seconds", "2 seconds")
    assert hot.select("w_start").distinct().count() == 30
    # All even bids hit five equally hot auctions: ties stay.
    assert [r[0] for r in hot.groupBy("w_start").count().select("count").distinct().collect()] == [5]
    q8 = nexmark.new_sellers(auctions, persons, "left", "10 seconds")
    assert (q8.count(), count_if(q8, "person_id IS NOT NULL")) == (N, 12_000)
    assert nexmark.new_sellers(auctions, persons, window="10 seconds").count() == 12_000


def test_persons_join_is_broadcast_only_when_small(spark, auction_tables):
    persons, auctions, _ = auction_tables
    matched = nexmark.local_sellers(auctions, persons)
    assert "BroadcastHashJoin" in plan_of(matched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = nexmark.local_sellers(auctions, persons)
        assert "SortMergeJoin" in plan_of(large)
        assert sorted(large.collect()) == sorted(matched.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wide_tables_cover_every_query(spark):
    assert set(KERNELS) <= set(gen.WIDE_TABLES)
    assert len([q for q in plans.queries() if q.startswith("rows_")]) == 22


# Output columns that tell whether a given row is a hit.
HIT_COLUMNS = ("passed_filter", "revenue_part", "total_value", "is_valid", "in_range")


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_every_kernel_hits_given_rows_and_misses_some(spark, name):
    rows = plans.queries()[f"rows_{name}"](spark, "/root/testdata/sf0.01")
    column = next(c for c in HIT_COLUMNS if c in rows.columns)
    hits, misses = rows.agg(F.count_if(F.col(column) != 0), F.count_if(F.col(column) == 0)).first()
    assert hits > 0 and misses > 0
