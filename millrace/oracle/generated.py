"""DuckDB answers for the row, numeric and payload kernels over the given tables.

Written from the definitions, not from the Spark code: one wide row per line, and
one statement per kernel over it.
"""

from __future__ import annotations

from ..sources import fixed_values as fx

ONE = "CAST(1 AS BIGINT) AS overhead"
SHIFT = 1096


def words(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values: list[str], place: str) -> str:
    return f"{words(values)}[CAST(({place}) % {len(values)} AS INT) + 1]"


def day(ts: str) -> str:
    return f"(CAST({ts} AS DATE) - DATE '1970-01-01' - {SHIFT})"


ENDINGS = ["ANODIZED STEEL", "BURNISHED COPPER", "POLISHED BRASS", "PLATED TIN", "BRUSHED NICKEL"]
COLOURS = ["forest", "green", "ivory", "linen"]
RECEIPT = f"({day('l_shipdate')} + 1 + (l_orderkey + l_linenumber) % 30)"
LATE = f"CASE WHEN {RECEIPT} > {day('o_orderdate')} + 60 THEN l_suppkey END"
WIDE = f"""WITH by_supplier AS (SELECT l_partkey kp, l_suppkey ks, sum(l_quantity) AS shipped, count(*) AS n FROM lineitem GROUP BY ALL),
of_part AS (SELECT kp, sum(shipped) / sum(n) AS avg_quantity, sum(shipped) / count(*) AS avail FROM by_supplier GROUP BY ALL),
of_order AS (SELECT l_orderkey ko, sum(l_quantity) AS total_quantity, min(l_suppkey) AS low, max(l_suppkey) AS high,
 min({LATE}) AS late_low, max({LATE}) AS late_high FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
wide AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
 o_orderkey, o_totalprice, c_custkey, c_name, s_name, p_partkey, p_brand, p_size, p_retailprice,
 {day('l_shipdate')} AS ship, {day('o_orderdate')} AS od, {day('o_orderdate')} + 60 AS cd, {RECEIPT} AS rd,
 {pick(fx.SHIP_MODES, 'l_linenumber')} AS l_shipmode, {pick(fx.SHIP_INSTRUCTS, 'l_suppkey')} AS instruct,
 c_mktsegment AS seg, o_orderpriority, o_orderstatus AS status,
 {pick(fx.NATIONS, 'c_nationkey')} AS c_nation, {pick(fx.NATIONS, 's_nationkey')} AS s_nation,
 cr.r_name AS c_region, cr.r_name AS r_name, sr.r_name AS s_region, sr.r_name AS region_name, sn.n_name AS nation_name,
 p_type || ' ' || {pick(ENDINGS, 'p_partkey')} AS p_type, {pick(COLOURS, 'p_partkey')} || ' ' || p_name AS p_name,
 {pick(fx.CONTAINERS, 'p_size - 1')} AS p_container, p_retailprice * 0.6::DOUBLE AS ps_supplycost,
 'addr_' || s_suppkey AS s_address, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS complaint,
 avg_quantity, avail, shipped, total_quantity, low, high, late_low, late_high
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN part ON l_partkey = p_partkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
 JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
 JOIN by_supplier b ON l_partkey = b.kp AND l_suppkey = b.ks JOIN of_part p ON l_partkey = p.kp JOIN of_order ON l_orderkey = ko)"""
NET = "l_extendedprice * (1.0::DOUBLE - l_discount)"


def from_wide(select: str) -> str:
    return f"{WIDE} SELECT {select} FROM wide"


def case(hit: str, value: str, other: str = "0.0::DOUBLE") -> str:
    return f"CASE WHEN {hit} THEN {value} ELSE {other} END"


def flag(hit: str) -> str:
    return f"CAST(CASE WHEN {hit} THEN 1 ELSE 0 END AS BIGINT)"


def passed(hit: str) -> str:
    return f"{flag(hit)} AS passed_filter, {ONE}"


def _row_kernels() -> dict[str, str]:
    sql: dict[str, str] = {}

    hit = "ship <= 10471"
    sql["q1"] = from_wide(
        f"l_returnflag, l_linestatus, {case(hit, NET)} AS disc_price, "
        f"{case(hit, f'{NET} * (1.0::DOUBLE + l_tax)')} AS charge, {passed(hit)}"
    )
    hit = "s_region = 'EUROPE' AND p_size = 15 AND p_type LIKE '%BRASS'"
    sql["q2"] = from_wide(f"s_name, s_nation, p_partkey, ps_supplycost, {passed(hit)}")
    hit = "seg = 'BUILDING' AND od < 9204 AND ship > 9204"
    sql["q3"] = from_wide(f"l_orderkey, {case(hit, NET)} AS revenue, CAST(od AS BIGINT) AS o_orderdate, {passed(hit)}")
    sql["q4"] = from_wide(
        f"o_orderpriority, {flag('cd < rd')} AS is_late, {flag('od >= 8582 AND od < 8674')} AS in_range, {ONE}"
    )
    hit = "r_name = 'ASIA' AND c_nation = s_nation AND od >= 8766 AND od < 9131"
    sql["q5"] = from_wide(f"c_nation AS n_name, {case(hit, NET)} AS revenue, {passed(hit)}")
    hit = ("ship >= 8766 AND ship < 9131 AND l_discount >= 0.05::DOUBLE "
           "AND l_discount <= 0.07::DOUBLE AND l_quantity < 24")
    sql["q6"] = from_wide(f"{case(hit, 'l_extendedprice * l_discount')} AS revenue_part, {ONE}")
    hit = ("ship >= 9131 AND ship <= 9861 AND ((s_nation = 'FRANCE' AND c_nation = 'GERMANY') "
           "OR (s_nation = 'GERMANY' AND c_nation = 'FRANCE'))")
    sql["q7"] = from_wide(
        f"{case(hit, 's_nation', 'NULL')} AS supp_nation, {case(hit, 'c_nation', 'NULL')} AS cust_nation, "
        f"CAST({case(hit, '1970 + ship // 365', 'NULL')} AS BIGINT) AS l_year, {case(hit, NET)} AS volume, {passed(hit)}"
    )
    hit = "c_region = 'AMERICA' AND p_type = 'ECONOMY ANODIZED STEEL' AND od >= 9131 AND od <= 9861"
    brazil = f"{hit} AND s_nation = 'BRAZIL'"
    sql["q8"] = from_wide(
        f"CAST({case(hit, '1970 + od // 365', '0')} AS BIGINT) AS o_year, "
        f"{case(hit, NET)} AS volume, {case(brazil, NET)} AS nation_volume, {passed(hit)}"
    )
    hit = "p_name LIKE '%green%'"
    sql["q9"] = from_wide(
        f"s_nation AS nation, CAST({case(hit, '1970 + od // 365', '0')} AS BIGINT) AS o_year, "
        f"{case(hit, f'{NET} - ps_supplycost * l_quantity')} AS profit, {passed(hit)}"
    )
    hit = "l_returnflag = 'R' AND od >= 8674 AND od < 8766"
    sql["q10"] = from_wide(f"c_custkey, c_name, c_nation, {case(hit, NET)} AS revenue, {passed(hit)}")
    hit = "s_nation = 'GERMANY'"
    sql["q11"] = from_wide(f"l_partkey AS ps_partkey, {case(hit, 'ps_supplycost * avail')} AS part_value, {passed(hit)}")
    hit = "l_shipmode IN ('MAIL', 'SHIP') AND cd < rd AND ship < cd AND rd >= 8766 AND rd < 9131"
    urgent = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
    sql["q12"] = from_wide(
        f"l_shipmode, {flag(f'{hit} AND {urgent}')} AS high_line, {flag(f'{hit} AND NOT ({urgent})')} AS low_line, {passed(hit)}"
    )
    sql["q13"] = (
        f"SELECT doc_id AS c_custkey, {flag('NOT regexp_matches(text, $$with.*that$$)')} AS is_valid, {ONE} FROM documents"
    )
    hit = "ship >= 9374 AND ship < 9404"
    promo = hit + " AND p_type LIKE 'PROMO%'"
    sql["q14"] = from_wide(f"{case(promo, NET)} AS promo_value, {case(hit, NET)} AS total_value, {ONE}")
    hit = "ship >= 9497 AND ship < 9588"
    sql["q15"] = from_wide(f"l_suppkey, {case(hit, NET)} AS revenue, {passed(hit)}")
    hit = ("p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM POLISHED%' "
           "AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND complaint = 0")
    sql["q16"] = from_wide(f"p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, l_suppkey AS ps_suppkey, {passed(hit)}")
    hit = "p_brand = 'Brand#23' AND p_container = 'MED BOX' AND l_quantity < 0.2::DOUBLE * avg_quantity"
    sql["q17"] = from_wide(f"{case(hit, 'l_extendedprice')} AS revenue_part, {passed(hit)}")
    hit = "total_quantity > 300"
    sql["q18"] = from_wide(f"c_name, c_custkey, o_orderkey, o_totalprice, total_quantity, {passed(hit)}")
    hit = (
        "instruct = 'DELIVER IN PERSON' AND l_shipmode IN ('AIR', 'AIR REG') AND ("
        "(p_brand = 'Brand#12' AND p_container IN ('SM CASE', 'SM BOX', 'SM PACK', 'SM PKG') "
        "AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR "
        "(p_brand = 'Brand#23' AND p_container IN ('MED BAG', 'MED BOX', 'MED PKG', 'MED PACK') "
        "AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR "
        "(p_brand = 'Brand#34' AND p_container IN ('LG CASE', 'LG BOX', 'LG PACK', 'LG PKG') "
        "AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))"
    )
    sql["q19"] = from_wide(f"{case(hit, NET)} AS revenue_part, {ONE}")
    hit = ("s_nation = 'CANADA' AND p_name LIKE 'forest%' AND ship >= 8766 AND ship < 9131 "
           "AND shipped > 0.5::DOUBLE * avail")
    sql["q20"] = from_wide(f"s_name, s_address, {passed(hit)}")
    hit = ("s_nation = 'SAUDI ARABIA' AND status = 'F' AND rd > cd AND (low <> l_suppkey OR high <> l_suppkey) "
           "AND NOT coalesce(late_low <> l_suppkey OR late_high <> l_suppkey, false)")
    sql["q21"] = from_wide(f"s_name, {flag(hit)} AS numwait, {passed(hit)}")
    hit = ("cntrycode IN (" + ", ".join(f"'{c}'" for c in fx.SALES_CODES) + ") AND c_acctbal > a AND NOT urgent")
    sql["q22"] = (
        "WITH m AS (SELECT sum(CAST(rint(c_acctbal * 100) AS BIGINT)) / count(*) / 100 AS a FROM customer WHERE c_acctbal > 0), "
        "c AS (SELECT CAST(c_nationkey + 10 AS VARCHAR) AS cntrycode, c_acctbal, a, "
        "c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer, m) "
        f"SELECT cntrycode, c_acctbal, {passed(hit)} FROM c"
    ).replace("rint(", "round(")
    return {f"rows_tpch_{name}": statement for name, statement in sql.items()}


def cdf(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {fx.ERF_P}::DOUBLE * {z}))"
    a1, a2, a3, a4, a5 = (f"({a}::DOUBLE)" for a in fx.ERF_A)
    poly = f"(({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))) * {t})"
    return (f"(0.5::DOUBLE * (1 + CASE WHEN {x} >= 0 THEN 1 ELSE -1 END "
            f"* (1 - {poly} * exp(-{z} * {z}))))")


OPTIONS = (
    "l_extendedprice / l_quantity AS spot, p_retailprice AS strike, (abs(ship - od) + 1) / 365 AS time_to_exp, "
    "l_discount AS risk_free, l_tax + 0.01::DOUBLE AS volatility"
)
CDF_INPUT = "(l_quantity - 25.5::DOUBLE) / 25.5::DOUBLE * 3 + (l_discount - 0.05::DOUBLE) * 20 AS v"
STRINGS16 = ("s_name", "nation_name", "region_name", "p_brand", "p_name", "p_type", "p_container", "l_returnflag")


def _strings(*columns: str) -> str:
    return from_wide(", ".join([*[f"{c} AS s_out{n}" for n, c in enumerate(columns, start=1)], ONE]))


def str16() -> str:
    return _strings(*STRINGS16)


def normal_cdf() -> str:
    return f"WITH src AS (SELECT {CDF_INPUT} FROM lineitem) SELECT v AS input_val, round({cdf('v')}, 8) AS cdf_result, {ONE} FROM src"


def call_price() -> str:
    return (
        f"{WIDE}, src AS (SELECT {OPTIONS} FROM wide), "
        "t AS (SELECT *, (ln(spot / strike) + (risk_free + 0.5::DOUBLE * volatility * volatility) "
        "* time_to_exp) / (volatility * sqrt(time_to_exp)) AS d1 FROM src), "
        "u AS (SELECT *, d1 - volatility * sqrt(time_to_exp) AS d2 FROM t) "
        f"SELECT round(spot * {cdf('d1')} - strike * exp(-risk_free * time_to_exp) * {cdf('d2')}, 8) AS call_price, {ONE} FROM u"
    )


def _kernels() -> dict[str, str]:
    return {
        "k_add": f"SELECT l_orderkey + l_partkey AS result, {ONE} FROM lineitem",
        "k_norm_cdf": normal_cdf(),
        "k_black_scholes": call_price(),
        "x_str0": f"SELECT l_quantity + l_discount AS r1, l_tax + l_extendedprice AS r2, {ONE} FROM lineitem",
        "x_str2": from_wide(f"s_name AS s_out, l_quantity + l_discount + l_tax AS r1, {ONE}"),
        "x_str4": _strings("s_name", "nation_name"),
        "x_str6": _strings("s_name", "nation_name", "region_name"),
        "x_str8": _strings("s_name", "nation_name", "region_name", "p_brand"),
        "x_str16": str16(),
        "x_len_short": from_wide(f"nation_name AS s_out, {ONE}"),
        "x_len_medium": from_wide(f"s_name AS s_out, {ONE}"),
        "x_len_long": f"SELECT text AS s_out, {ONE} FROM documents",
    }


def ms(ts: str) -> str:
    return f"CAST(CAST({ts} AS DATE) - DATE '1970-01-01' AS BIGINT) * 86400000"


PERSONS = (
    "SELECT c_custkey AS p_id, c_name AS name, c_mktsegment AS city, "
    f"{pick(fx.US_STATES, 'c_nationkey + c_custkey')} AS state, (9131 + c_custkey * 7 % 2400) * 86400000 AS p_date_time FROM customer"
)
AUCTIONS = (
    "SELECT o_orderkey AS a_id, o_custkey AS seller, CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderpriority[1] AS INT) * 5 "
    f"ELSE o_orderkey % 20 END AS INT) AS category, {ms('o_orderdate')} AS a_date_time FROM orders"
)
BIDS = f"SELECT l_orderkey * 8 + l_linenumber AS bid_id, l_partkey AS auction, {ms('l_shipdate')} AS date_time FROM lineitem"


def _sources() -> dict[str, str]:
    return {
        "src_lineitem_gen": (
            "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
            f"CAST({day('l_shipdate')} AS INT) AS l_shipdate_days FROM lineitem"
        ),
        "src_options_gen": from_wide(OPTIONS),
        "src_wide_rows": from_wide(
            "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipmode, status AS o_orderstatus, c_name, c_nation, s_name, s_nation, s_address, "
            "complaint AS is_complaint, p_type, p_name, p_container, ps_supplycost, avg_quantity, avail AS ps_availqty, shipped AS shipped_qty, "
            "total_quantity AS order_total_qty, CASE WHEN low <> l_suppkey OR high <> l_suppkey THEN 1 ELSE 0 END AS has_other_supplier, "
            "CASE WHEN coalesce(late_low <> l_suppkey OR late_high <> l_suppkey, false) THEN 1 ELSE 0 END AS other_also_late"
        ),
        "src_nexmark_persons": PERSONS,
        "src_nexmark_auctions": AUCTIONS,
        "src_nexmark_bids": BIDS,
    }


def statements() -> dict[str, str]:
    return {**_row_kernels(), **_kernels(), **_sources()}
