"""DuckDB answers for the row kernels over the given tables."""

from __future__ import annotations

from .generated import NET, ONE, case, flag, passed

SHIP = "l_shipdate"
Q1 = f"{SHIP} <= DATE '1998-09-02'"
Q3 = f"c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND {SHIP} > DATE '1995-03-15'"
Q14 = f"{SHIP} >= DATE '1995-09-01' AND {SHIP} < DATE '1995-10-01'"
# One day after the calendar quarter, as the kernel has it.
Q15 = f"{SHIP} >= DATE '1996-01-02' AND {SHIP} < DATE '1996-04-02'"


def statements() -> dict[str, str]:
    return {
        "given_rows_tpch_q1": (
            f"SELECT l_returnflag, l_linestatus, {case(Q1, NET)} AS disc_price, "
            f"{case(Q1, f'{NET} * (1 + l_tax)')} AS charge, {passed(Q1)} FROM lineitem"
        ),
        "given_rows_tpch_q3": (
            f"SELECT l_orderkey, {case(Q3, NET)} AS revenue, "
            f"CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS o_orderdate, {passed(Q3)} "
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
        ),
        "given_rows_tpch_q14": (
            "SELECT " + case(f"{Q14} AND p_type LIKE 'PROMO%'", NET) + " AS promo_value, "
            f"{case(Q14, NET)} AS total_value, {ONE} FROM lineitem JOIN part ON l_partkey = p_partkey"
        ),
        "given_rows_tpch_q15": (
            f"SELECT l_suppkey, {case(Q15, NET)} AS revenue, {flag(Q15)} AS passed_filter, {ONE} FROM lineitem"
        ),
    }
