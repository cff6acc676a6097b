"""Rows of the kernels when lines meet no more than a kernel needs, against the whole wide table."""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from millrace.operators.row_kernels import KERNELS
from millrace.plans import row_inputs
from millrace.plans.generated import WIDE_COLUMNS, queries
from test_plans import formatted_plan

NAMES = [n for n in row_inputs.MEETS if n in KERNELS]
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
}


def day(n: int) -> datetime:
    return datetime(1997, 1, 1) + timedelta(n)


def odd_rows() -> dict[str, list[tuple]]:
    """Keys that are null, missing or there more than once, with other values in each row."""
    regions = ["EUROPE", "ASIA", "AMERICA"]
    rows = {
        "region": [(n, name) for n, name in enumerate(regions)] + [(1, "ASIA"), (None, "NOWHERE")],
        "nation": [(n, f"nation {n}", [0, 1, 2, None, 9][n % 5]) for n in range(9)] + [(2, "again", 0), (None, None, 0)],
        "customer": [(n % 9 or None, f"customer {n}", n % 8 if n % 7 else None, n - 5.0, ["BUILDING", "MACHINERY", None][n % 3]) for n in range(14)],
        "supplier": [(n % 8 or None, f"supplier {n}", n % 8 if n % 6 else None, [n - 4.0, None][n % 5 == 4]) for n in range(11)],
        "part": [(n % 9 or None, ["green", "forest green", None][n % 3], f"Brand#{n % 3}{n % 5}", "PROMO" if n % 2 else "ECONOMY", n % 40 if n % 4 else None,
                  900.0 + n) for n in range(13)],
        "orders": [(n % 15 or None, n % 10, "FO"[n % 2], 100.0 * n, day(n * 61 % 500) if n % 6 else None, ["1-URGENT", "5-LOW", None][n % 3]) for n in range(24)],
        "lineitem": [(n % 16 or None, n * 5 % 11 or None, n * 3 % 10 or None, n % 7, float(n % 50) if n % 9 else None, 1000.0 + n, n % 11 / 100, 0.01, "ANR"[n % 3],
                      "OF"[n % 2], day(n * 37 % 600) if n % 13 else None) for n in range(150)],
    }
    return rows | {"lineitem": rows["lineitem"] + rows["lineitem"][:20]}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name, rows in odd_rows().items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def bag(df) -> Counter:
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize(("name", "a_task"), [
    *[(name, 25) for name in (*NAMES, "src_wide_rows")], *[(name, row_inputs.LINES_A_TASK) for name in ("tpch_q9", "tpch_q17", "tpch_q18", "src_wide_rows")],
])
def test_lines_meet_the_rows_of_the_whole_wide_table(spark, odd_dir, monkeypatch, name, a_task):
    monkeypatch.setattr(row_inputs, "LINES_A_TASK", a_task)
    kernel = KERNELS.get(name, lambda df: df.select(*WIDE_COLUMNS))
    expected = bag(kernel(row_inputs.wide_rows(spark, odd_dir)))
    assert bag(kernel(row_inputs.met_rows(spark, odd_dir, name))) == expected and sum(expected.values()) > 40


@pytest.mark.parametrize("name", NAMES)
def test_a_kernel_shuffles_its_lines_once_by_order_and_once_by_part(spark, sf_dir, monkeypatch, name):
    """With large tables, and suppliers that are broadcast: the whole table had three scans of the lines."""
    monkeypatch.setattr(row_inputs, "LINES_A_TASK", 600)
    plan = formatted_plan(spark, KERNELS[name](row_inputs.met_rows(spark, sf_dir, name)))
    assert len(re.findall(r"Location: .*lineitem", plan)) == 1, plan
    shuffled = [x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan) if "l_" in x]
    assert len(shuffled) == 2 and len(re.findall(r"hashpartitioning\(l_\w+#\w+, 10\), REPARTITION_BY_NUM", plan)) == 2, plan
    unread = {"tpch_q3": "p_|l_quantity|c_name", "tpch_q14": "l_quantity|o_orderdate|s_name|l_returnflag", "tpch_q21": "l_extendedprice|p_|c_"}
    assert not [x for x in shuffled if re.search(unread.get(name, "s_acctbal|l_tax"), x)], shuffled


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_lines_are_not_shuffled_to_meet_suppliers(spark, odd_dir, monkeypatch, sent):
    """Whatever the session's threshold is; beyond the number of suppliers that may be sent, they are, with the same rows."""
    want = bag(row_inputs.lines_met(spark, odd_dir, ("supplier", "orders", "part")))
    monkeypatch.setattr(row_inputs, "SUPPLIERS_SENT", sent)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = row_inputs.lines_met(spark, odd_dir, ("supplier", "orders", "part"))
        plan = formatted_plan(spark, met)
        shuffled = [x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan) if "l_orderkey" in x]
        assert len(shuffled) == (3 if sent == 0 else 2), plan
        assert want and bag(met) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_the_rows_of_the_kernel_are_written(spark, sf_dir):
    rows = queries()["rows_tpch_q14"](spark, sf_dir)
    assert spark.read.parquet(*rows.inputFiles()).columns == rows.columns == ["promo_value", "total_value", "overhead"]
    assert rows.inputFiles() == queries()["rows_tpch_q14"](spark, sf_dir).inputFiles()
