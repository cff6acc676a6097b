"""Grouping that leaves a preceding join free to split hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_after_join(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """``df.groupBy(keys).agg(aggregates)`` with a shuffle of its own.

    When a join is followed by a grouping on the join key, Spark reuses the
    join's partitioning, and adaptive execution then may not split a skewed
    join partition because that would undo the reuse. Grouping by one struct of
    the keys is the same grouping, but is not satisfied by the join's
    partitioning: rows are pre-aggregated where the join ran, and a hot key is
    joined by many tasks and arrives here as one row from each.
    """
    grouped = df.groupBy(F.struct(*keys).alias("_key")).agg(*aggregates)
    measures = [c for c in grouped.columns if c != "_key"]
    return grouped.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *measures)
