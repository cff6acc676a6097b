"""Run queries beside their SQL answers and compare them value for value.

    python tests/compare.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.sources.tables import TABLES  # noqa: E402

# Spark type -> DuckDB type that the answer must have.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def expected(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[dict[str, str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = sorted(range(len(names)), key=names.__getitem__)
    return types, Counter(tuple(row[i] for i in order) for row in cursor.fetchall())


def actual(df) -> tuple[dict[str, str], Counter]:
    names = sorted(df.columns)
    rows = Counter(tuple(row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    return dict(df.dtypes), rows


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types and the multiset of rows are the same."""
    want_types, want = expected(con, sql)
    got_types, got = actual(df)
    problems = []
    if set(want_types) != set(got_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    for name, spark_type in got_types.items():
        if SAME_TYPE.get(spark_type) != want_types[name]:
            problems.append(f"{name}: {spark_type} against {want_types[name]}")
    if got != want:
        missing, extra = want - got, got - want
        problems.append(
            f"{got.total()} rows against {want.total()}; missing {missing.total()} "
            f"e.g. {list(missing)[:2]}; extra {extra.total()} e.g. {list(extra)[:2]}"
        )
    return problems


def main(sf_dir: str, prefixes: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from millrace.session import local_session

    spark = local_session(8)
    con = open_tables(sf_dir)
    sql = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                problems = differences(df, con, sql[name])
                rows = "" if problems else "same"
            else:
                problems, rows = [], f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            problems, rows = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} {time.time() - start:6.2f}s {rows}", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    for name in sorted(set(sql) - set(queries())):
        bad += 1
        print("FAIL", name, "has SQL but no query")
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
