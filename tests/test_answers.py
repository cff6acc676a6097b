"""Every query beside its SQL answer, on the given tables and on a skewed copy."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from compare import differences, open_tables

from __spark_entry__ import entry, oracle_sql, queries
from millrace.sources.tables import TABLES

# The training-data operators have tests of their own.
OWN_TESTS = re.compile(r"op\d+_|pipeline$")
QUERIES = {name: query for name, query in queries().items() if not OWN_TESTS.match(name)}
SQL = {name: sql for name, sql in oracle_sql().items() if not OWN_TESTS.match(name)}


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_tables(sf_dir)


#: Measured times, which differ from run to run. What is the same in every run is ``udf_overhead_rows``.
MEASURED = {"udf_overhead"}


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(SQL) | MEASURED


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory, sf_dir):
    """The tables with a third of the lines on one order, part and supplier, a
    third of the orders on one customer, a third of the events on one user, and
    a third of the suppliers under one name."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    replace = "CASE WHEN n % 3 = 0 THEN {hot} ELSE {c} END AS {c}"
    hot = {
        "lineitem": {
            # An order that the supplier queries look at, a red part, a supplier of nation 9.
            "l_orderkey": f"(SELECT min(o_orderkey) FROM '{sf_dir}/orders.parquet' WHERE o_orderstatus = 'F')",
            "l_partkey": f"(SELECT min(p_partkey) FROM '{sf_dir}/part.parquet' WHERE p_name LIKE 'red%')",
            "l_suppkey": f"(SELECT min(s_suppkey) FROM '{sf_dir}/supplier.parquet')",
        },
        "orders": {"o_custkey": "7"},
        "events": {"user_id": "3"},
        # Names need not be unique.
        "supplier": {"s_name": "'Supplier#000000001'"},
    }
    for name in TABLES:
        source, target = f"{sf_dir}/{name}.parquet", os.path.join(folder, f"{name}.parquet")
        if name not in hot:
            os.symlink(source, target)
            continue
        replaced = ", ".join(
            replace.format(hot=key, c=column) for column, key in hot[name].items()
        )
        con.execute(
            f"COPY (SELECT * EXCLUDE (n) REPLACE ({replaced}) FROM "
            f"(SELECT *, row_number() OVER () AS n FROM '{source}')) TO '{target}' (FORMAT parquet)"
        )
    return folder


SKEWED = [n for n in SQL if n.startswith(("tpch_", "ev_", "log_", "bench_", "udaf_"))]


@pytest.mark.parametrize("name", SKEWED)
def test_same_as_sql_with_hot_keys(spark, skewed_dir, name):
    con = open_tables(skewed_dir)
    assert differences(QUERIES[name](spark, skewed_dir), con, SQL[name]) == []


def test_a_hot_order_is_split_in_q3(spark, sf_dir, tmp_path):
    """Forty times the lines, a third of them on one order that Q3 looks at."""
    con = duckdb.connect()
    for name in TABLES:
        os.symlink(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet") if name != "lineitem" else None
    hot = (f"(SELECT min(o_orderkey) FROM '{sf_dir}/orders.parquet' JOIN '{sf_dir}/customer.parquet' ON o_custkey = c_custkey "
           "WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15')")
    con.execute(
        f"COPY (SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN {hot} ELSE l_orderkey END AS l_orderkey) FROM "
        f"(SELECT l.*, row_number() OVER () AS n FROM '{sf_dir}/lineitem.parquet' l, range(40) ORDER BY hash(l_orderkey, l_linenumber, range))) "
        f"TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 20000)"
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "1MB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = QUERIES["tpch_q3"](spark, str(tmp_path))
        assert differences(df, open_tables(str(tmp_path)), SQL["tpch_q3"]) == []
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
