"""Whole queries over the given tables, keyed by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, generated, given_rows, nexmark, streams, tpch, user_functions

FAMILIES = (generated, given_rows, tpch, nexmark, user_functions, analysis, streams)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in FAMILIES:
        for name, query in family.queries().items():
            if name in found:
                raise ValueError(f"two queries are named {name!r}")
            found[name] = query
    return found
