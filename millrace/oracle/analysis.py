"""DuckDB answers for sources, log metrics and benchmark comparison."""

from __future__ import annotations

from ..sources.tables import TABLES

UNITS = "CAST(round(value * 100) AS BIGINT)"
TENTHS = f"({UNITS} // 10) || '.' || ({UNITS} % 10)"
WALLCLOCK = f"'Count=1000000 | WallClock=' || {TENTHS} || ' ms | Avg UDF=' || {UNITS}"
THROUGHPUT = f"' ns | Throughput=' || {UNITS} || '000 rows/s'"
LOG = (
    "log AS (SELECT 'q' || user_id AS query, event_id AS seq, CASE "
    f"WHEN event_type = 'view' THEN '[q' || user_id || ' Benchmark] ' || {WALLCLOCK} "
    f"|| ' ns | Avg Overhead=' || {UNITS} || '0' || {THROUGHPUT} "
    f"WHEN event_type = 'click' THEN '[q' || user_id || ' Benchmark] ' || {WALLCLOCK} || {THROUGHPUT} "
    f"WHEN event_type = 'error' THEN '[q' || user_id || ' Benchmark] WARMUP ' || {WALLCLOCK} || {THROUGHPUT} "
    "WHEN event_type = 'purchase' AND user_id % 3 > 0 "
    f"THEN '[Job Summary] Job ID=7, Duration=' || {TENTHS} || ' sec' "
    f"WHEN user_id % 5 > 0 THEN '  Wall time    : ' || {TENTHS} || ' s' "
    "ELSE 'plain output' END AS line FROM events)"
)


def found(pattern: str, text: str = "line") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


METRICS = (
    f"WITH {LOG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY seq DESC) AS r, "
    "count(*) OVER (PARTITION BY query) AS n FROM log "
    "WHERE line LIKE '%[%Benchmark]%' AND line NOT LIKE '%WARMUP%'), "
    "chosen AS (SELECT * FROM ranked WHERE r = least(n, 2)), "
    f"d AS (SELECT query, last({found('Duration=([0-9.]+)')} ORDER BY seq) "
    "FILTER (line LIKE '%Duration=%') AS duration, "
    f"last({found('Wall time *: *([0-9.]+)')} ORDER BY seq) FILTER (line LIKE '%Wall time%') AS wall "
    "FROM log GROUP BY query) "
    "SELECT query, "
    + ", ".join(
        f"coalesce({found(pattern)}, 'N/A') AS {name}"
        for name, pattern in {
            "avg_udf_ns": "Avg UDF=([0-9]+)",
            "avg_overhead_ns": "Avg Overhead=([0-9]+)",
            "rows_per_s": "Throughput=([0-9]+)",
            "wallclock_ms": "WallClock=([0-9.]+)",
        }.items()
    )
    + ", coalesce(duration, wall, 'N/A') AS duration_s FROM d LEFT JOIN chosen USING (query)"
)

COMPARED = (
    "WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS file, event_type || '_' || (user_id % 4) AS benchmark, "
    "avg(value / [1.0::DOUBLE, 1e3, 1e6, 1e9][user_id % 4 + 1]) AS mean FROM events GROUP BY ALL), "
    "f AS (SELECT count(DISTINCT file) AS n, min(file) AS base FROM m), "
    "common AS (SELECT benchmark FROM m GROUP BY benchmark HAVING count(*) = (SELECT n FROM f)), "
    "b AS (SELECT benchmark, mean AS base_mean FROM m WHERE file = (SELECT base FROM f)), "
    "c AS (SELECT m.*, base_mean, base_mean / mean AS ratio FROM m JOIN common USING (benchmark) "
    "JOIN b USING (benchmark)), "
    "u AS (SELECT *, CASE WHEN base_mean >= 1 THEN 'sec' WHEN base_mean >= 1e-3 THEN 'ms' "
    "WHEN base_mean >= 1e-6 THEN 'us' ELSE 'ns' END AS unit FROM c), "
    "s AS (SELECT *, mean / CASE unit WHEN 'sec' THEN 1.0::DOUBLE WHEN 'ms' THEN 1e-3 "
    "WHEN 'us' THEN 1e-6 ELSE 1e-9 END AS scaled FROM u), "
    "g AS (SELECT file, exp(avg(ln(ratio))) AS geomean FROM c GROUP BY file)"
)


WIDE = (
    f"{COMPARED}, cells AS (SELECT 0 AS seq, benchmark, unit, file, scaled AS value FROM s UNION ALL "
    "SELECT 1 AS seq, 'geometric mean' AS benchmark, 'NA' AS unit, file, geomean AS value FROM g) "
    "SELECT seq, benchmark, unit, count(*) AS n_files, min(file) AS first_file, round(arg_min(value, file), 6) AS first_value, "
    "max(file) AS last_file, round(arg_max(value, file), 6) AS last_value, "
    "string_agg(file || '=' || CAST(round_even(value * 1000000, 0) AS BIGINT), ';' ORDER BY file) AS cells FROM cells GROUP BY ALL"
)

MEASURED = "SELECT strftime(ts, '%Y-%m-%d') AS file, event_type AS benchmark, value FROM events"


def statements() -> dict[str, str]:
    return {
        "src_driver_tables": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES
        ),
        "src_bench_json": MEASURED,
        "src_bench_json_split": MEASURED,
        "src_run_log": f"WITH {LOG} SELECT query, seq, line FROM log",
        "run_report": (
            "SELECT 'tpch_q6' AS tag, count(*) AS input_rows, count(*) AS expected_rows, count(*) AS output_rows, true AS timed FROM lineitem"
        ),
        "log_metrics": METRICS,
        "bench_compare": f"{COMPARED} SELECT file, benchmark, round(ratio, 6) AS ratio FROM c",
        "bench_summary": f"{COMPARED} SELECT file, round(geomean, 6) AS geomean FROM g",
        "bench_units": f"{COMPARED} SELECT file, benchmark, unit, round(scaled, 6) AS scaled FROM s",
        "bench_wide": WIDE,
        "bench_pivot": (
            f"{COMPARED} SELECT 0 AS seq, benchmark, unit, file, round(scaled, 6) AS value FROM s UNION ALL "
            "SELECT 1 AS seq, 'geometric mean' AS benchmark, 'NA' AS unit, file, round(geomean, 6) AS value FROM g"
        ),
    }
