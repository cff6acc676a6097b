"""Rows per second of one kernel over each transport, on generated rows.

    python bench_transports.py [ROWS] [CPUS]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.functions import udfs  # noqa: E402
from millrace.operators import payloads  # noqa: E402
from millrace.operators.reports import discard  # noqa: E402
from millrace.operators.row_kernels import KERNELS  # noqa: E402
from millrace.session import local_session  # noqa: E402
from millrace.sources.generated import wide_table  # noqa: E402


def forms(spark, rows):
    lines = wide_table(spark, "tpch_q1", rows)
    for transport in udfs.TRANSPORTS:
        yield f"pricing {transport}", udfs.call_struct(
            lines, udfs.pricing_udf(transport), udfs.PRICING_INPUTS
        )
    yield "pricing native", KERNELS["tpch_q1"](lines)
    values = wide_table(spark, "norm_cdf", rows)
    for transport in udfs.TRANSPORTS:
        yield f"norm_cdf {transport}", values.select(udfs.norm_cdf_udf(transport)("v"))
    yield "norm_cdf native", payloads.normal_cdf(values)
    strings = wide_table(spark, "str16", rows)
    inputs = [c for c in strings.columns if c.startswith("s_in")]
    yield "strings Arrow arrays", udfs.call_struct(strings, udfs.string_batch_udf(len(inputs)), inputs)
    yield "strings native", payloads.pass_strings(strings)


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    cpus = sys.argv[2] if len(sys.argv) > 2 else str(os.cpu_count())
    spark = local_session(cpus, "transports")
    for _, df in forms(spark, 10_000):
        discard(df)
    rates = {}
    for name, df in forms(spark, rows):
        started = time.perf_counter()
        discard(df)
        rates[name] = round(rows / (time.perf_counter() - started))
        print(f"{name:20s} {rates[name]:>14,} rows/s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"rows": rows, "cpus": cpus, "rows_per_s": rates}))


if __name__ == "__main__":
    main()
