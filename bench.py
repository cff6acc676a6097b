"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default: all) the local cores. Every query is planned afresh and run to the
noop sink, so all rows and columns are computed and nothing is written. The
time of a query is the better of two runs after the session has warmed up.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from millrace.operators.reports import discard  # noqa: E402
from millrace.plans import all_queries  # noqa: E402
from millrace.plans.row_inputs import wide_rows  # noqa: E402
from millrace.session import local_session  # noqa: E402

RUNS = 2
HEADLINE = [
    *[f"tpch_q{n}" for n in range(1, 23)],
    *[f"rows_tpch_q{n}" for n in range(1, 23)],
    "k_add", "k_norm_cdf", "k_black_scholes",
    "x_str0", "x_str2", "x_str4", "x_str6", "x_str8", "x_str16", "x_str16_arrow",
    "x_len_short", "x_len_medium", "x_len_long",
    "nexmark_q3", "nexmark_q5", "nexmark_q5_hot_items", "nexmark_q8",
    "ev_hot_types", "ev_new_user_buyers",
    # One kernel over each transport, beside rows_tpch_q1 and k_norm_cdf.
    "udf_scalar_struct", "udf_arrow_scalar", "udf_pandas_struct",
    "udf_row_norm_cdf", "udf_pandas_norm_cdf",
    "udtf_price_progress", "udf_closure_lookup", "log_metrics", "bench_compare", "bench_wide",
    "stream_price_native", "stream_price_lateral", "stream_vectorised_calc", "stream_statement_set",
    "stream_nexmark_q5", "stream_nexmark_q8", "stream_nexmark_q8_outer", "stream_ev_hot_types", "src_stream_datagen",
    "given_rows_tpch_q1", "given_rows_tpch_q3", "given_rows_tpch_q14", "given_rows_tpch_q15",
]
# Same result, cheapest transport last: seconds are comparable row by row.
TRANSPORTS = {
    "pricing": ["udf_scalar_struct", "udf_arrow_scalar", "udf_pandas_struct", "rows_tpch_q1"],
    "norm_cdf": ["udf_row_norm_cdf", "udf_pandas_norm_cdf", "k_norm_cdf"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    queries = all_queries()
    only = sys.argv[1:] or HEADLINE

    for warm in ("tpch_q3", "rows_tpch_q1"):
        discard(queries[warm](spark, sf_dir))

    seconds = {}
    if not sys.argv[1:]:
        # Written once for the row kernels, which then only scan it: what they would join otherwise.
        started = time.perf_counter()
        wide_rows(spark, sf_dir)
        seconds["wide_rows_written"] = round(time.perf_counter() - started, 4)
    for name in only:
        times = []
        for _ in range(RUNS):
            started = time.perf_counter()
            discard(queries[name](spark, sf_dir))
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times), 4)
        print(f"{name:24s} {seconds[name]:8.3f} s", file=sys.stderr, flush=True)

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    report = {
        "metric": "total wall seconds of the headline queries, noop sink",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
        "lineitem_rows": rows,
        "rows_per_s": {
            kernel: {n: round(rows / seconds[n]) for n in names if n in seconds}
            for kernel, names in TRANSPORTS.items()
        },
    }
    spark.stop()
    print(json.dumps(report), flush=True)


if __name__ == "__main__":
    main()
