from __future__ import annotations

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.functions import udfs
from millrace.functions.numeric import display_unit, geometric_mean, in_unit
from millrace.operators import reports
from millrace.sources import split_documents
from millrace.sources.bench_results import read_bench_results
from millrace.sources.generated import wide_table
from millrace.sources.run_logs import read_run_log, write_run_log
from millrace.sources.split_documents import fragments, read_large_results, write_large_results
from millrace.sources.tables import table
from millrace.streaming import prices, runs


def run(*values, name=None):
    entry = {"values": list(values), "warmups": [[1, 9.9]]} if values else {"warmups": [[1, 9.9]]}
    return {**entry, "metadata": {"name": name, "load": 1.5} if name else {"load": 1.5}}


DOCUMENTS = {
    "own.json": {"benchmarks": [{"metadata": {"name": "a"}, "runs": [run(), run(1.0, 2.0), run(3.0, name="x")]}]},
    "in_run.json": {"benchmarks": [{"runs": [run(), run(4.0, name="b"), run(5.0, name="c")]}]},
    "top.json": {"benchmarks": [{"runs": [run(6.0)]}], "metadata": {"name": "d", "tags": ["t"]}, "version": "1"},
    "nameless.json": {"benchmarks": [{"runs": [run(7.0)]}]},
    "single.json": {"runs": [run(8.0), run(9.0)], "metadata": {"name": "e"}},
    "unknown.json": {"runs": [run(10.0)]},
    "empty.json": {"runs": [run()], "metadata": {"name": "f"}},
}


def test_result_documents(spark, tmp_path):
    for name, document in DOCUMENTS.items():
        (tmp_path / name).write_text(json.dumps(document, indent=2))
    rows = read_bench_results(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.benchmark, r.value) for r in rows) == [
        ("in_run.json", "b", 4.0),
        ("in_run.json", "b", 5.0),
        ("own.json", "a", 1.0),
        ("own.json", "a", 2.0),
        ("own.json", "a", 3.0),
        ("single.json", "e", 8.0),
        ("single.json", "e", 9.0),
        ("top.json", "d", 6.0),
        ("unknown.json", "unknown", 10.0),
    ]


ODD = 'quote " brace { } {" back \\\\ slash \\" [{ end \\\\'
LARGE = {
    "long.json": {"version": "1", "tags": [{"name": "no"}, {"runs": [run(0.5)]}], "benchmarks": [
        {"metadata": {"name": f"{ODD}{n % 7}" if n % 3 else None}, "runs": [run(n + 0.25, name=f"{ODD}r{n}" if n % 2 else None), run(), run(n + 0.5, n + 0.75)]}
        for n in range(60)], "metadata": {"name": ODD, "deep": {"name": "no", "metadata": {"name": "no"}}}},
    "alone.json": {"metadata": {"load": 1.0}, "runs": [run(float(n), name=f"n{n}" if n > 3 else None) for n in range(80)], "version": "{"},
    "none.json": {"version": "1"},
    "with space.json": {"benchmarks": [], "metadata": {"name": "z"}},
}


@pytest.mark.parametrize("indent", [None, 2])
def test_a_large_document_is_read_by_several_tasks(spark, tmp_path, indent):
    for name, document in {**DOCUMENTS, **LARGE}.items():
        (tmp_path / name).write_text(json.dumps(document, indent=indent))
    (tmp_path / "blank.json").write_text(" \n")
    want = sorted((r.file, r.benchmark, r.value) for r in read_bench_results(spark, str(tmp_path)).collect())
    assert len(want) > 250
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.file, r.benchmark, r.value) for r in read_large_results(spark, str(tmp_path)).collect())
            assert got == want
            splits = fragments(spark, str(tmp_path / "long.json")).select("split").distinct().count()
            assert splits > 10 if size == "997" else splits == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fragments_are_shuffled_three_times_without_the_path_of_their_file(spark, tmp_path, monkeypatch):
    (tmp_path / "long.json").write_text(json.dumps(LARGE["long.json"]))
    seen = []

    def recorded(df):
        utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
        seen.extend(re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", utils.explainString(df._jdf.queryExecution(), "formatted")))
        return df

    kept = split_documents._kept
    monkeypatch.setattr(split_documents, "_kept", lambda rows, name: kept(recorded(rows), name))
    assert recorded(read_large_results(spark, str(tmp_path))).count() > 100
    with_text = [columns for columns in seen if re.search(r"\btext#|\bmember#\w+, buf#", columns)]
    assert len(with_text) == 3 and not [columns for columns in with_text if "file#" in columns], seen


def test_large_documents_written_and_read(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('b', id % 5) as benchmark", "id / 4 as value", "id as seq")
    write_large_results(rows, str(tmp_path / "three"), 200)
    assert len(list((tmp_path / "three").glob("part-*"))) == 3
    got = read_large_results(spark, str(tmp_path / "three")).groupBy("benchmark", "value").count().collect()
    assert sorted((r.benchmark, r.value) for r in got) == sorted((f"b{n % 5}", n / 4) for n in range(500))
    write_large_results(rows.limit(0), str(tmp_path / "no"), 200)
    assert read_large_results(spark, str(tmp_path / "no")).count() == 0


def test_unknown_table(spark, sf_dir):
    with pytest.raises(ValueError):
        table(spark, sf_dir, "partsupp")


def metric(n, extra=""):
    return (f"[Q3 Benchmark] {extra}Count=1000000 | WallClock={n}.5 ms | Avg UDF={n} ns | "
            f"Avg Overhead={n}0 ns | Throughput={n}00 rows/s")


def test_log_metrics(spark, tmp_path):
    logs = {
        "second_to_last": [metric(1), metric(2), metric(3), "[Job Summary] Job ID=0, Duration=1.25 sec",
                           "[Job Summary] Job ID=1, Duration=2.50 sec", "  Wall time    : 9.99 s"],
        "only_one": [metric(1, "WARMUP "), metric(4), metric(5, "WARMUP "), "  Wall time    : 7.75 s"],
        "incomplete": ["[Q3 Benchmark] Count=1 | Avg UDF=8 ns"],
        "no_data": ["Duration=3.0", metric(6, "WARMUP ")],
    }
    lines = [(q, i, text) for q, texts in logs.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame(lines, "query string, seq long, line string").repartition(3)
    path = str(tmp_path / "log")
    write_run_log(df, path)
    got = {r.query: tuple(r)[1:] for r in reports.log_metrics(read_run_log(spark, path)).collect()}
    assert got == {
        "second_to_last": ("2", "20", "200", "2.5", "2.50"),
        "only_one": ("4", "40", "400", "4.5", "7.75"),
        "incomplete": ("8", "N/A", "N/A", "N/A", "N/A"),
        "no_data": ("N/A", "N/A", "N/A", "N/A", "3.0"),
    }


def test_log_lines_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("q", 1, metric(1))], "query string, seq long, line string")
    plan = reports.log_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


MEASURED = [
    ("a", "slow", 2.0), ("a", "slow", 4.0), ("a", "quick", 3e-5), ("a", "gone", 1.0),
    ("b", "slow", 6.0), ("b", "quick", 1.5e-5), ("b", "new", 1.0),
]


def test_comparison(spark):
    df = spark.createDataFrame(MEASURED, "file string, benchmark string, value double")
    rows = {(r.file, r.benchmark): r for r in reports.compare_files(df).collect()}
    assert set(rows) == {("a", "slow"), ("a", "quick"), ("b", "slow"), ("b", "quick")}
    assert rows["b", "slow"].ratio == 0.5 and rows["b", "quick"].ratio == pytest.approx(2.0)
    means = {r.file: r.geomean for r in reports.summarize(reports.compare_files(df)).collect()}
    assert means == {"a": pytest.approx(1.0), "b": pytest.approx(1.0)}
    other = {(r.file, r.benchmark): r.ratio for r in reports.compare_files(df, "b").collect()}
    assert other["a", "slow"] == 2.0

    cells = reports.comparison_table(df)
    assert cells.count() == 6
    wide = reports.side_by_side(cells, ["a", "b"]).orderBy("seq", "benchmark").collect()
    assert [(r.benchmark, r.unit) for r in wide] == [("quick", "us"), ("slow", "sec"), ("geometric mean", "NA")]
    assert wide[1].a == 3.0 and wide[1].b == 6.0 and wide[0].a == pytest.approx(30.0)


def test_display_units(spark):
    values = [1.0, 0.999, 1e-3, 9.9e-4, 1e-6, 9.9e-7, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(display_unit(F.col("v")).alias("u")).collect()
    assert [r.u for r in rows] == ["sec", "ms", "ms", "us", "us", "ns", "ns"]
    assert df.select(in_unit(F.lit(0.25), F.lit("ms"))).first()[0] == 250.0


def test_geometric_mean_forms(spark):
    data = [("x", 2.0), ("x", 8.0), ("x", -5.0), ("x", 0.0), ("none", -1.0), (None, 3.0), ("y", None), ("y", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    native = {r.g: r.m for r in df.groupBy("g").agg(geometric_mean(F.col("v")).alias("m")).collect()}
    batches = {r.g: r.geomean for r in udfs.geometric_mean_batches(df.repartition(3), "g", "v").collect()}
    assert native == {"x": pytest.approx(4.0), "none": 1.0, None: pytest.approx(3.0), "y": pytest.approx(4.0)}
    assert batches == {g: pytest.approx(m) for g, m in native.items()}


def test_run_report(spark):
    row = reports.run_report(spark.range(1000), "range", 1000, 1000).first()
    assert (row.tag, row.input_rows, row.expected_rows, row.output_rows) == ("range", 1000, 1000, 1000)
    assert row.wall_s > 0 and row.rows_per_s == pytest.approx(1000 / row.wall_s)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_transports_agree_and_call_the_function_once(spark):
    lines = wide_table(spark, "tpch_q1", 3000)
    results = {}
    for transport in udfs.TRANSPORTS:
        df = udfs.call_struct(lines, udfs.pricing_udf(transport), udfs.PRICING_INPUTS)
        plan = plan_of(df)
        node = "BatchEvalPython" if transport == "row" else "ArrowEvalPython"
        assert plan.count(node) == 1
        assert df.filter("py_duration < 0").count() == 0
        results[transport] = sorted(df.drop("py_duration").collect())
    assert results["row"] == results["arrow"] == results["pandas"]
    with pytest.raises(ValueError):
        udfs.pricing_udf("carrier pigeon")


def test_cdf_transports_agree(spark):
    values = wide_table(spark, "norm_cdf", 2000)
    forms = [
        [r[0] for r in values.select(udfs.norm_cdf_udf(t)("v")).collect()] for t in udfs.TRANSPORTS
    ]
    for one, two, three in zip(*forms):
        assert math.isclose(one, two, abs_tol=1e-12) and math.isclose(one, three, abs_tol=1e-12)


def test_lookup_in_tasks(spark):
    rows = spark.range(100).select("id", (F.col("id") % 12).alias("k"))
    lookup = spark.range(20).select((F.col("id") % 10).alias("k"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("name"))
    mapped = udfs.lookup_in_tasks(rows, lookup, "k", "name")
    assert "FlatMapCoGroupsInArrow" in plan_of(mapped) and mapped.columns == ["id", "k", "name"]
    # Of two values the smaller; no value, no row lost.
    assert {(r.id, r.k, r.name) for r in mapped.collect()} == {
        (n, n % 12, f"n{n % 12:02d}" if n % 12 < 10 else None) for n in range(100)}


@pytest.mark.parametrize("share_rows", [7, 50, 10_000])
def test_lookup_in_shares_with_hot_and_null_keys(spark, share_rows):
    """A third of the rows on one key, a fifth without any, equal rows among them, and a null key in the table."""
    data = [(n if n % 4 else 7, "k1" if n % 3 == 0 else None if n % 5 == 0 else f"k{n % 40}") for n in range(600)] + [(1, "k1")] * 200
    rows = spark.createDataFrame(data, "`the id` long, `value` string").repartition(5).withColumnRenamed("value", "share")
    lookup = spark.createDataFrame([(f"k{n}", n) for n in range(30)] + [(None, 99), ("k1", 0)], "share string, part long")
    got = udfs.lookup_in_tasks(rows, lookup, "share", "part", share_rows)
    known = {f"k{n}": n for n in range(30)} | {"k1": 0}
    assert got.columns == ["the id", "share", "part"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, k, known.get(k)) for i, k in data), key=repr)
    assert udfs.lookup_in_tasks(rows, lookup.limit(0), "share", "part", share_rows).filter("part IS NOT NULL").count() == 0
    assert udfs.lookup_in_tasks(rows.limit(0), lookup, "share", "part", share_rows).count() == 0


def test_no_share_of_a_lookup_is_much_larger_than_asked_for(spark):
    rows = spark.range(6000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("c0"), F.lit("same").alias("c1"))
    entries = spark.range(500).select(F.col("id").alias("key"), F.col("id").alias("value"))
    placed, index = udfs.dealt_shares(rows, entries, "c0", 400)
    sizes = [r["count"] for r in placed.groupBy("share", "part").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1000 and len(sizes) > 15
    assert index.filter("key = 1").count() == 6 and index.count() == 505  # 2,001 rows of key 1


def test_progress_of_partitions_in_order(spark):
    data = [(n, "ab"[n % 2], float(n) if n % 7 else None) for n in range(25)]
    df = spark.createDataFrame(data, "id long, kind string, price double").repartition(4)
    got = udfs.price_progress(df, F.col("kind"), F.col("id"), F.col("price"), 5)
    want = set()
    for kind in "ab":
        own = [r for r in data if r[1] == kind]
        for n in range(len(own)):
            if (n + 1) % 5 == 0 or n == len(own) - 1:
                want.add((kind, n + 1, own[n][0], sum(round((p + 1) * 100) for _, _, p in own[:n + 1] if p is not None)))
    rows = got.collect()
    assert {tuple(r)[:4] for r in rows} == want and len(rows) == len(want) and all(r.spent_ns > 0 for r in rows)
    assert udfs.price_progress(df.limit(0), F.col("kind"), F.col("id"), F.col("price"), 5).count() == 0
    for every in (0, -1):
        with pytest.raises(Exception, match="positive"):
            udfs.price_progress(df, F.col("kind"), F.col("id"), F.col("price"), every).collect()


def test_wide_table_of_any_files(spark):
    rows = [(f"f{n % 5}", b, float(v)) for n in range(20) for b, v in (("x", n + 1), ("y", 2 * n + 1))]
    cells = reports.comparison_table(spark.createDataFrame(rows, "file string, benchmark string, value double"))
    wide = reports.wide_table(cells)
    got = {r.benchmark: r["values"] for r in wide.collect()}
    assert set(got) == {"x", "y", reports.SUMMARY_LABEL} and all(list(v) == [f"f{n}" for n in range(5)] for v in got.values())
    assert {(r.benchmark, r.file): r.value for r in cells.collect()} == {(b, f): x for b, v in got.items() for f, x in v.items()}
    cut, pivoted = reports.with_columns(wide, ["f1", "f9"]), reports.side_by_side(cells, ["f1", "f9"])
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(map(tuple, pivoted.collect()), key=repr)


def test_two_table_functions_at_once_and_their_report(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("price"), F.lit(1).cast("long").alias("start_ns")).coalesce(1)
    one = udfs.price_step(df)
    two = udfs.price_step(df.withColumnRenamed("id", "odd name"))
    assert sorted(r["odd name"] for r in two.collect()) == sorted(r.id for r in one.collect()) == list(range(10))
    report = udfs.price_report(df).collect()
    assert [r.rows for r in report] == [10] and report[0].spent_ns >= 0


def test_comparison_of_many_files(spark):
    many = spark.range(1500).select(
        F.format_string("f%05d", "id").alias("file"), F.lit("b").alias("benchmark"), (F.col("id") + 1).cast("double").alias("value"))
    assert reports.comparison_table(many).count() == 3000


def test_overhead_is_what_the_tasks_had_less_the_function(spark):
    df = spark.range(1000, numPartitions=4).select("id", (F.col("id") * 10).alias("spent"), F.when(F.col("id") > 5, 1).alias("x"))
    r = reports.function_overhead(df, "t", "spent", {"x": F.sum("x"), "top": F.max("id")}).first()
    assert (r.tag, r.rows, r.x, r.top, r.at_once) == ("t", 1000, 994, 999, 4) and r.mean_function_ns == 4995
    assert abs(r.mean_function_ns + r.mean_overhead_ns - r.wall_s * 4e9 / 1000) < 1e-3 and abs(r.rows_per_s - 1000 / r.wall_s) < 1e-6
    assert reports.function_overhead(df, "t", "spent", at_once=1).first().at_once == 1
    nothing = reports.function_overhead(df.filter("id < 0").withColumn("spent", F.lit(None).cast("long")), "none", "spent").first()
    assert nothing.rows == 0 and nothing.mean_function_ns is None and nothing.mean_overhead_ns is None


def test_every_transport_has_its_times(spark, sf_dir):
    report = {r.tag: r for r in queries()["udf_overhead"](spark, sf_dir).collect()}
    assert set(report) == {"row", "arrow", "pandas", "native"}
    assert report["native"].mean_function_ns == 0 and all(report[t].mean_function_ns > 0 for t in ("row", "arrow", "pandas"))
    assert len({(r.rows, r.passed, r.charged_cents) for r in report.values()}) == 1


def test_overhead_of_a_stream_by_micro_batch(spark):
    rows = spark.range(300).repartition(3).select("id", F.col("id").cast("double").alias("price"))
    found = prices.step_overhead(runs.as_stream(rows, files_per_trigger=1), 180).collect()
    assert len(found) == 3 and sum(r.rows for r in found) == 300
    assert all(r.mean_function_ns > 0 and r.mean_overhead_ns > 0 and r.rows_per_s > 0 for r in found)
    assert prices.step_overhead(runs.as_stream(rows.limit(0)), 180).count() == 0
