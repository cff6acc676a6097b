"""What the plans and the library must not contain."""

from __future__ import annotations

import pathlib
import re

import pytest
from __spark_entry__ import queries
from millrace.plans import row_inputs
from pyspark.sql import functions as F

ROOT = pathlib.Path(__file__).resolve().parent.parent
# The training-data operators have tests of their own.
QUERIES = {n: q for n, q in queries().items() if not re.match(r"op\d+_|pipeline$", n)}
PYTHON_ON_PURPOSE = ("udf_", "udtf_", "udaf_geomean_pandas", "x_str16_arrow", "stream_", "run_report")
BATCH = [n for n in QUERIES if not n.startswith(("stream_", "src_stream", "run_report", "udf_overhead"))]


LARGER_DIR = "/root/testdata/sf0.01"


def formatted_plan(spark, df):
    utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins_and_no_stray_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if not name.startswith(PYTHON_ON_PURPOSE):
        assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", [n for n in BATCH if n.startswith("tpch_")])
def test_same_shape_when_nothing_fits_a_broadcast(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = formatted_plan(spark, QUERIES["tpch_q6"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    for wanted in ("GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate", "LessThan(l_quantity", "(l_discount"):
        assert wanted in pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {
        "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    }


#: Scans and joins when nothing is broadcast: of the tables whose columns a kernel reads, and no others.
SHAPES = {
    "x_str0": (1, 0), "x_str2": (2, 1), "x_len_medium": (2, 1), "x_str4": (3, 2), "x_len_short": (3, 2), "x_str6": (4, 3), "x_str8": (5, 4),
}


@pytest.mark.parametrize("name", SHAPES)
def test_kernels_join_what_their_columns_need(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (len(re.findall("FileScan parquet", plan)), len(re.findall("SortMergeJoin", plan))) == SHAPES[name], plan


@pytest.mark.parametrize("name", [n for n in BATCH if n.startswith("rows_tpch_q") and n != "rows_tpch_q22"])
def test_row_kernels_scan_one_table_and_shuffle_nothing(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert len(re.findall("FileScan parquet", plan)) == 1 and "Exchange" not in plan and "Join" not in plan, plan


def test_the_wide_table_aggregates_lines_once_by_part_and_once_by_order(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(row_inputs.wide_plan(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 3 and len(re.findall("SortMergeJoin", plan)) == 11, plan


def test_the_wide_table_is_written_once_for_each_version_of_its_tables(spark, sf_dir, tmp_path):
    for name in row_inputs.WIDE_FROM:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = row_inputs.wide_rows(spark, str(tmp_path))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert first.inputFiles() == row_inputs.wide_rows(spark, str(tmp_path)).inputFiles() and first.count() == lines.count()
    lines.limit(10).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    again = row_inputs.wide_rows(spark, str(tmp_path))
    assert not set(again.inputFiles()) & set(first.inputFiles()) and again.count() == lines.count() + 10


def test_the_wide_table_shuffles_lines_by_pair_order_and_supplier_with_their_own_columns(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = formatted_plan(spark, row_inputs.wide_plan(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sum("l_extendedprice" in columns for columns in shuffled) == 3, shuffled
    follows = ("l_shipmode", "l_shipinstruct", "l_tax", "p_container", "ps_supplycost", "s_address", "c_nation#", "avg_quantity", "ps_availqty")
    assert not [name for name in follows for columns in shuffled if name in columns]


def test_the_wide_table_deals_lines_to_tasks_of_bounded_size(spark, monkeypatch):
    rows = row_inputs.wide_plan(spark, LARGER_DIR)
    monkeypatch.setattr(row_inputs, "LINES_A_TASK", 2_500)
    dealt = row_inputs.wide_plan(spark, LARGER_DIR)
    assert len(re.findall(r"Exchange hashpartitioning\(.*, 24\), REPARTITION_BY_NUM", plan_of(dealt))) == 4
    hashes = [df.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first() for df in (rows, dealt)]
    assert hashes[0] == hashes[1] and hashes[0][0] == 60_000


@pytest.mark.parametrize("name", ["nexmark_q5", "nexmark_q5_hot_items"])
def test_copies_of_panes_are_summed_in_tasks_of_bounded_size(spark, monkeypatch, name):
    rows = QUERIES[name](spark, LARGER_DIR)
    monkeypatch.setattr(row_inputs, "LINES_A_TASK", 2_500)
    dealt = QUERIES[name](spark, LARGER_DIR)
    assert re.search(r"Exchange hashpartitioning\(auction#\w+, 24\), REPARTITION_BY_NUM", plan_of(dealt))
    assert rows.exceptAll(dealt).count() == dealt.exceptAll(rows).count() == 0


@pytest.mark.parametrize("name", [n for n in BATCH if n.startswith(("tpch_", "ev_", "log_", "bench_"))])
def test_results_are_not_empty(spark, name):
    assert QUERIES[name](spark, LARGER_DIR).limit(1).count() == 1


def test_library_keeps_data_off_the_driver():
    forbidden = r"\.collect\(\)|toPandas|crossJoin|localCheckpoint|\.toLocalIterator|broadcast\(|\.rdd\b"
    for path in (ROOT / "millrace").rglob("*.py"):
        if path.parent.name == "llm":
            continue
        found = re.findall(forbidden, path.read_text())
        assert not found, (path, found)
