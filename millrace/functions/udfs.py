"""User functions in Python: the same kernels over each transport Spark offers.

Measuring what a Python function costs beside its native form is a purpose of
this library, so each kernel here has a native twin elsewhere and returns the
same values. Use the native twin in a real plan.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources.fixed_values import DAY_1998_09_02, ERF_A, ERF_P

PRICING_SCHEMA = (
    "l_returnflag string, l_linestatus string, disc_price double, charge double, "
    "passed_filter long, py_duration long"
)
PRICING_INPUTS = [
    "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", "l_tax", "l_shipdate_days",
]
TRANSPORTS = ("row", "arrow", "pandas")


def _price_line(returnflag, linestatus, price, discount, tax, ship_days):
    """Q1 for one row, with the nanoseconds it took."""
    started = time.perf_counter_ns()
    kept = ship_days is not None and ship_days <= DAY_1998_09_02
    net = charge = 0.0
    if kept:
        net = None if price is None or discount is None else price * (1.0 - discount)
        charge = None if net is None or tax is None else net * (1.0 + tax)
    return returnflag, linestatus, net, charge, int(kept), time.perf_counter_ns() - started


def _price_batch(
    returnflag: pd.Series,
    linestatus: pd.Series,
    price: pd.Series,
    discount: pd.Series,
    tax: pd.Series,
    ship_days: pd.Series,
) -> pd.DataFrame:
    started = time.perf_counter_ns()
    kept = (ship_days <= DAY_1998_09_02).to_numpy()
    net = np.where(kept, price * (1.0 - discount), 0.0)
    out = pd.DataFrame(
        {
            "l_returnflag": returnflag,
            "l_linestatus": linestatus,
            "disc_price": net,
            "charge": np.where(kept, net * (1.0 + tax), 0.0),
            "passed_filter": kept.astype("int64"),
        }
    )
    # A batch is timed once; every row carries its share.
    out["py_duration"] = (time.perf_counter_ns() - started) // max(len(out), 1)
    return out


def pricing_udf(transport: str):
    """The Q1 kernel as a struct function: pickled rows, Arrow rows, or pandas batches."""
    if transport == "row":
        return F.udf(_price_line, PRICING_SCHEMA, useArrow=False)
    if transport == "arrow":
        return F.udf(_price_line, PRICING_SCHEMA, useArrow=True)
    if transport == "pandas":
        return F.pandas_udf(_price_batch, PRICING_SCHEMA)
    raise ValueError(f"unknown transport {transport!r}, expected one of {TRANSPORTS}")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def call_struct(df: DataFrame, function: Callable[..., Column], inputs: list[str]) -> DataFrame:
    """Call a struct function once per row and unpack its fields.

    The struct is a column of its own before it is unpacked; unpacking the call
    directly would evaluate the function once per field.
    """
    return df.select(function(*inputs).alias("r")).select("r.*")


def call_struct_sql(
    spark: SparkSession, df: DataFrame, function, inputs: list[str]
) -> DataFrame:
    """The same through SQL, with the function registered under a name of its own."""
    name = f"process_{uuid.uuid4().hex}"
    spark.udf.register(name, function)
    call = f"{name}({', '.join(map(quoted, inputs))})"
    return spark.sql(f"SELECT r.* FROM (SELECT {call} AS r FROM {{source}}) t", source=df)


def _erf_poly(t):
    total = 0.0
    for a in reversed(ERF_A):
        total = (total + a) * t
    return total


def norm_cdf_udf(transport: str):
    """The normal distribution function as a Python function."""

    def one(x: float) -> float | None:
        if x is None:
            return None
        z = abs(x) / math.sqrt(2.0)
        erf = 1.0 - _erf_poly(1.0 / (1.0 + ERF_P * z)) * math.exp(-z * z)
        return 0.5 * (1.0 + math.copysign(erf, x))

    def batch(x: pd.Series) -> pd.Series:
        z = x.abs() / math.sqrt(2.0)
        erf = 1.0 - _erf_poly(1.0 / (1.0 + ERF_P * z)) * np.exp(-z * z)
        return 0.5 * (1.0 + np.copysign(erf, x))

    if transport == "pandas":
        return F.pandas_udf(batch, "double")
    return F.udf(one, "double", useArrow=transport == "arrow")


def string_batch_udf(count: int):
    """Pass ``count`` strings through as Arrow arrays: no Python string is made."""
    names = [f"s_out{i}" for i in range(1, count + 1)]

    def batch(*columns: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(list(columns), names=names)

    return F.arrow_udf(batch, ", ".join(f"{n} string" for n in names))


PRICE_STEP_COLUMNS = "price double, start_ns long, py_duration long, end_ns long"


# Not by Arrow: a lateral join calls the function row by row, and a batch of one row each time took
# ten times as long (18 s for 100,000 rows, against 1.7 s pickled).
@F.udtf(returnType=PRICE_STEP_COLUMNS)
class PriceStep:
    """Table function: one output row per input row, with the time it took."""

    def eval(self, price: float, start_ns: int):
        started = time.perf_counter_ns()
        price = None if price is None else price + 1
        yield price, start_ns, time.perf_counter_ns() - started, time.time_ns()


@F.udtf(returnType="rows long, spent_ns long")
class PriceStepReport:
    """What a partition's rows took together: one row at the end of each partition.

    ``rows`` and ``spent`` are the function's open state: they live as long as
    the partition it runs over.
    """

    def __init__(self):
        self.rows = 0
        self.spent = 0

    def eval(self, price: float, start_ns: int):
        started = time.perf_counter_ns()
        price = None if price is None else price + 1
        self.rows += 1
        self.spent += time.perf_counter_ns() - started

    def terminate(self):
        if self.rows:
            yield self.rows, self.spent


def price_report(df: DataFrame, price: str = "price", start: str = "start_ns") -> DataFrame:
    """(rows, spent_ns) per partition of ``df``."""
    spark = df.sparkSession
    name = f"price_report_{uuid.uuid4().hex}"
    spark.udtf.register(name, PriceStepReport)
    return spark.sql(
        f"SELECT t.* FROM {{source}} s, LATERAL {name}(s.{quoted(price)}, s.{quoted(start)}) t", source=df
    )


def price_step(df: DataFrame, price: str = "price", start: str = "start_ns") -> DataFrame:
    """LATERAL join of every row with the table function's output for it."""
    spark = df.sparkSession
    name = f"price_step_{uuid.uuid4().hex}"
    spark.udtf.register(name, PriceStep)
    keep = ", ".join(f"s.{quoted(c)}" for c in df.columns if c not in (price, start))
    return spark.sql(
        f"SELECT {keep}, t.* FROM {{source}} s, LATERAL {name}(s.{quoted(price)}, s.{quoted(start)}) t",
        source=df,
    )


def geometric_mean_batches(df: DataFrame, group: str, value: str) -> DataFrame:
    """Geometric mean per group as a user aggregate in pandas.

    Each Arrow batch is reduced to one row per group before anything is
    shuffled. A grouped-aggregate pandas function would need a whole group in
    one task's memory.
    """
    group_type = dict(df.dtypes)[group]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            positive = batch[value] > 0
            logs = np.log(batch[value].where(positive, 1.0))
            sums = pd.DataFrame({group: batch[group], "logs": logs, "n": positive.astype("int64")})
            yield sums.groupby(group, as_index=False, dropna=False).sum()

    parts = df.select(group, value).mapInPandas(
        partial, f"`{group}` {group_type}, logs double, n long"
    )
    mean = F.exp(F.sum("logs") / F.nullif(F.sum("n"), F.lit(0)))
    return parts.groupBy(group).agg(F.coalesce(mean, F.lit(1.0)).alias("geomean"))


#: Rows and keys that one task of a lookup holds at a time.
SHARE_ROWS = 200_000


def dealt_shares(rows: DataFrame, entries: DataFrame, key: str, share_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows, and entries (key, value) with one row per key, with ``share`` and ``part``: where they meet.

    Keys are dealt into shares by hash. Of a key with more rows than a share holds, the rows are dealt into
    as many parts as they fill, and its entry goes to each."""
    counted = rows.groupBy(F.col(key).alias("busy")).agg(F.count(F.lit(1)).alias("n"))
    total = (counted.agg(F.sum("n")).first()[0] or 0) + entries.count()
    shares = F.lit(max(1, math.ceil(total / share_rows)))
    busy = counted.filter(F.col("n") > share_rows).select("busy", F.ceil(F.col("n") / share_rows).alias("parts"))
    # Which part a row is in follows from its columns and the task that reads it: equal rows are spread too.
    hashed = [F.col(n) for n, t in rows.dtypes if not re.search("map|variant", t)]
    placed = rows.withColumn("spread", F.xxhash64(F.spark_partition_id(), *hashed)).join(busy, F.col(key).eqNullSafe(F.col("busy")), "left")
    placed = placed.select(
        *rows.columns, F.pmod(F.xxhash64(key), shares).alias("share"), F.pmod("spread", F.coalesce("parts", F.lit(1))).alias("part"))
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)
    index = entries.join(busy, F.col("key") == F.col("busy"), "left").select(
        "key", "value", F.pmod(F.xxhash64("key"), shares).alias("share"), F.explode(parts).alias("part"))
    return placed, index


def lookup_in_tasks(df: DataFrame, lookup: DataFrame, key: str, value: str, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Add ``value`` by looking ``key`` up in an index that each task builds of its share of the table.

    Both tables are dealt into shares and meet share by share, so either may be of any size, and so may be
    the rows of one key. Of several values of a key, the smallest is taken; keys not found, and null ones,
    give null. ``value`` must not be a column of ``df``.
    """
    inner = {c: f"c{n}" for n, c in enumerate(df.columns)}
    rows = df.select(*[F.col(quoted(c)).alias(n) for c, n in inner.items()])
    entries = lookup.filter(F.col(quoted(key)).isNotNull()).groupBy(F.col(quoted(key)).alias("key")).agg(F.min(quoted(value)).alias("value"))
    placed, index = dealt_shares(rows, entries, inner[key], share_rows)

    def add(part: pa.Table, known: pa.Table) -> pa.Table:
        place = pc.index_in(part[inner[key]], value_set=known["key"].combine_chunks())
        return part.select(list(inner.values())).append_column("value", known["value"].take(place))

    schema = ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, ("value", dict(entries.dtypes)["value"])])
    met = placed.groupBy("share", "part").cogroup(index.groupBy("share", "part")).applyInArrow(add, schema)
    return met.toDF(*df.columns, value)


class PriceProgress:
    """Table function over a table argument: a running report of each partition, in the order of its rows.

    The argument has columns ``part``, ``id`` and ``price``; the caller partitions it by ``part`` and orders
    it by ``id``. After every ``every`` rows, and at the end of the partition, a row tells how many rows
    there were, the last id, the sum of their stepped prices in hundredths, and the nanoseconds they took.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, every: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if not isinstance(every.value, int) or every.value < 1:
            raise ValueError("the second argument is a positive number of rows")
        missing = {"part", "id", "price"} - set(rows.dataType.names)
        if missing:
            raise ValueError(f"the table lacks {sorted(missing)}")
        report = StructType().add("part", rows.dataType["part"].dataType).add("rows", "long")
        return AnalyzeResult(report.add("last_id", rows.dataType["id"].dataType).add("total_cents", "long").add("spent_ns", "long"))

    def __init__(self):
        self.rows = self.cents = self.spent = self.reported = 0
        self.part = self.last = None

    def eval(self, row, every: int):
        started = time.perf_counter_ns()
        self.part, self.last = row["part"], row["id"]
        if row["price"] is not None:
            self.cents += round((row["price"] + 1) * 100)
        self.rows += 1
        self.spent += time.perf_counter_ns() - started
        if self.rows % every == 0:
            self.reported = self.rows
            yield self._report()

    def terminate(self):
        if self.rows > self.reported:
            yield self._report()

    def _report(self):
        return self.part, self.rows, self.last, self.cents, self.spent


def price_progress(df: DataFrame, part: Column, order: Column, price: Column, every: int) -> DataFrame:
    """(part, rows, last_id, total_cents, spent_ns) of each partition, every so many rows and at its end.
    A partition is read by one task, row by row: choose ones of bounded size."""
    rows = df.select(part.alias("part"), order.alias("id"), price.alias("price"))
    return F.udtf(PriceProgress)(rows.asTable().partitionBy("part").orderBy("id"), F.lit(every))
