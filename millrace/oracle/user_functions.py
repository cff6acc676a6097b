"""DuckDB answers for the user-function queries."""

from __future__ import annotations

from . import generated

PRICED = "SELECT event_id AS id, value + 1 AS price FROM events"
GEOMEAN = (
    "SELECT event_type, round(coalesce(exp(avg(ln(value)) FILTER (value > 0)), 1.0::DOUBLE), 6) "
    "AS geomean FROM events GROUP BY event_type"
)


def statements() -> dict[str, str]:
    from_kernels = generated.statements()
    pricing = from_kernels["rows_tpch_q1"]
    return {
        "x_str16_arrow": generated.str16(),
        "udf_scalar_struct": pricing,
        "udf_arrow_scalar": pricing,
        "udf_pandas_struct": pricing,
        "udf_row_norm_cdf": generated.normal_cdf(),
        "udf_pandas_norm_cdf": generated.normal_cdf(),
        "udf_overhead_rows": (
            f"SELECT tag, count(*) AS rows, CAST(sum(passed_filter) AS BIGINT) AS passed, "
            "CAST(sum(CAST(round_even(charge * 100, 0) AS BIGINT)) AS BIGINT) AS charged_cents, true AS timed "
            f"FROM ({pricing}), (SELECT unnest(['row', 'arrow', 'pandas', 'native']) AS tag) GROUP BY tag"
        ),
        "udf_closure_lookup": (
            "SELECT c_custkey, c_nationkey, n_name FROM customer "
            "LEFT JOIN nation ON c_nationkey = n_nationkey"
        ),
        "udtf_price": PRICED,
        "udtf_price_progress": (
            "WITH e AS (SELECT event_type || '/' || strftime(ts, '%Y-%m-%d') AS part, event_id, CAST(round((value + 1) * 100) AS BIGINT) AS cents FROM events), "
            "r AS (SELECT part, event_id AS last_id, row_number() OVER w AS rows, CAST(sum(cents) OVER w AS BIGINT) AS total_cents, "
            "count(*) OVER (PARTITION BY part) AS n FROM e WINDOW w AS (PARTITION BY part ORDER BY event_id ROWS UNBOUNDED PRECEDING)) "
            "SELECT part, rows, last_id, total_cents FROM r WHERE rows % 100 = 0 OR rows = n"
        ),
        "udf_timed_java_equiv": PRICED,
        "udaf_geomean": GEOMEAN,
        "udaf_geomean_pandas": GEOMEAN,
    }
