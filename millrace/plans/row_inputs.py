"""Inputs of the kernels, derived from the given tables.

A kernel reads one wide row: a line with its order, customer, supplier and part.
What the given tables lack is a stated function of what they have:

* Dates are shifted back by 1,096 days: the given calendar starts in 1995, the
  workload's in 1992. Commit date: 60 days after the order. Receipt date: 1 to 30
  days after shipping, by order and line number.
* Nations have their key's name in the workload's list. Ship mode follows from the
  line number, ship instruction from the supplier, container from the part's size.
* A part's type and name are its own words with two more, chosen by its key.
* Supply cost: 60 % of the retail price. Available quantity: what a supplier of the
  part has shipped on average. Shipped quantity, average quantity of a part, total
  quantity of an order and its other suppliers are aggregates of the lines.
* A complaint is a negative balance of the supplier. A customer's country code is
  its nation's key plus ten, and "has orders" means an urgent one.
* The comments of Q13 are the texts of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import fixed_values as fx
from ..sources.tables import row_count, table, version
from ..sources.workspace import fresh_folder

col = F.col

SHIFT_DAYS, COMMIT_DAYS, RECEIPT_SPREAD = 1096, 60, 30
TYPE_ENDINGS = ["ANODIZED STEEL", "BURNISHED COPPER", "POLISHED BRASS", "PLATED TIN", "BRUSHED NICKEL"]
NAME_COLOURS = ["forest", "green", "ivory", "linen"]
# What Q13 looks for in texts, as words in this order.
COMMENT_WORDS = ("with", "that")


def days(name: str) -> Column:
    return F.unix_date(col(name).cast("date")) - SHIFT_DAYS


def chosen(words: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(place, F.lit(len(words))) + 1).cast("int"))


def of_line() -> dict[str, Column]:
    """What follows from a line's own columns."""
    later = F.pmod(col("l_orderkey") + col("l_linenumber"), F.lit(RECEIPT_SPREAD))
    return {
        "l_shipmode": chosen(fx.SHIP_MODES, col("l_linenumber")),
        "l_shipinstruct": chosen(fx.SHIP_INSTRUCTS, col("l_suppkey")),
        "l_receiptdate_days": (col("l_shipdate_days") + 1 + later).cast("int"),
    }


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_shipdate_days", days("l_shipdate")).withColumns(of_line())


def with_orders(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate_days", days("o_orderdate"))
    return df.join(orders, col("l_orderkey") == col("o_orderkey")).withColumn(
        "l_commitdate_days", col("o_orderdate_days") + COMMIT_DAYS
    )


def of_part() -> dict[str, Column]:
    """What follows from a part's own columns; of the names that change, the old ones are read."""
    return {
        "p_type": F.concat_ws(" ", "p_type", chosen(TYPE_ENDINGS, col("p_partkey"))),
        "p_name": F.concat_ws(" ", chosen(NAME_COLOURS, col("p_partkey")), "p_name"),
        "p_container": chosen(fx.CONTAINERS, col("p_size") - 1),
        "ps_supplycost": col("p_retailprice") * F.lit(0.6),
    }


def with_parts(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumns(of_part())
    return df.join(parts, col("l_partkey") == col("p_partkey")).withColumn("ps_partkey", col("l_partkey"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(col("doc_id").alias("c_custkey"), col("text").alias("o_comment"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    average = customers.filter(col("c_acctbal") > 0).agg((exact_cents() / 100).alias("a")).scalar()
    urgent = table(spark, sf_dir, "orders").filter(col("o_orderpriority") == "1-URGENT").select("o_custkey").distinct()
    return customers.join(urgent, col("c_custkey") == col("o_custkey"), "left").select(
        (col("c_nationkey") + 10).cast("string").alias("cntrycode"), "c_acctbal", average.alias("avg_acctbal"),
        F.when(col("o_custkey").isNotNull(), 1).otherwise(0).alias("has_orders"),
    )


def exact_cents() -> Column:
    """The mean balance in cents; sums of whole cents do not depend on the order of rows."""
    return F.sum(F.rint(col("c_acctbal") * 100).cast("long")) / F.count("*")


#: What the wide table is made of, and the kernels that read the lines alone.
WIDE_FROM = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region")
OF_LINES = ("tpch_q1", "tpch_q6", "tpch_q15")
#: Lines that a task has on average at most, however large the table is.
LINES_A_TASK = 250_000
#: Suppliers that are sent to every task, whatever the session's threshold: at most so many rows of a few columns,
#: where shuffling lines to meet them would write all lines once more. More of them are joined as Spark decides.
SUPPLIERS_SENT = 1_000_000
_written: dict[tuple, tuple[str, StructType]] = {}


def tasks_of_lines(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts lines are dealt: the session's number, or more when its parts would be too large."""
    wanted = -(-row_count(spark, sf_dir, "lineitem") // LINES_A_TASK)
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """The rows dealt out by key. Where the session's number of parts will do, Spark deals them out itself,
    and may put small parts together and split large ones."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def with_regions(df: DataFrame, spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    """Customers or suppliers of known nations, with the name of the region."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", col("r_name").alias(f"{prefix}_region"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(regions, col("n_regionkey") == col("r_regionkey"))
    return df.join(nations, col(f"{prefix}_nationkey") == col("n_nationkey")).drop("n_nationkey", "n_regionkey", "r_regionkey")


def order_facts(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """Of each order's lines the total quantity, and the smallest and largest supplier of all and of the
    late ones, which tell of a line whether there is another, so that an order's lines are never paired.
    Which lines are late the orders tell."""
    late = F.when(col("l_receiptdate_days") > col("l_commitdate_days"), col("l_suppkey"))
    line = lines(spark, sf_dir).select("l_orderkey", "l_suppkey", "l_quantity", "l_receiptdate_days")
    return with_orders(dealt(line, tasks, "l_orderkey"), spark, sf_dir).groupBy(col("l_orderkey").alias("k_order")).agg(
        F.sum("l_quantity").alias("order_total_qty"), F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"),
        F.min(late).alias("late_low"), F.max(late).alias("late_high"))


def order_rows(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """A row per order with its customer and the facts of its lines."""
    customers = with_regions(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), spark, sf_dir, "c")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate_days", days("o_orderdate")).drop("o_orderdate")
    return orders.join(customers, col("o_custkey") == col("c_custkey")).drop("c_custkey").join(
        order_facts(spark, sf_dir, tasks), col("o_orderkey") == col("k_order")).drop("k_order")


def part_rows(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """A row per part and supplier: the part, the quantity the supplier shipped of it, and the part's
    quantity, lines and suppliers. The lines are dealt out by part once, which serves the sums by
    supplier, those by part and the join with the parts."""
    by_supplier = table(spark, sf_dir, "lineitem").select(
        col("l_partkey").alias("k_part"), col("l_suppkey").alias("k_supp"), "l_quantity",
    ).repartition(tasks, "k_part").groupBy("k_part", "k_supp").agg(F.sum("l_quantity").alias("shipped_qty"), F.count("*").alias("n"))
    part = Window.partitionBy("k_part")
    return by_supplier.select(
        "k_part", "k_supp", "shipped_qty", F.sum("shipped_qty").over(part).alias("part_qty"),
        F.sum("n").over(part).alias("part_lines"), F.count("*").over(part).alias("part_suppliers"),
    ).join(table(spark, sf_dir, "part"), col("k_part") == col("p_partkey")).drop("p_partkey")


def wide_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line with what a kernel needs of the tables; the rest follows row by row in ``wide_columns``.
    Lines are shuffled twice, with no more than that: by part and supplier, then by order."""
    tasks = tasks_of_lines(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        days("l_shipdate").alias("l_shipdate_days"))
    suppliers = with_regions(table(spark, sf_dir, "supplier"), spark, sf_dir, "s").withColumn(
        "is_complaint", F.when(col("s_acctbal") < 0, 1).otherwise(0)).drop("s_acctbal")

    def other(low: str, high: str) -> Column:
        return F.when((col(low) != col("l_suppkey")) | (col(high) != col("l_suppkey")), 1).otherwise(0)

    same_pair = (col("l_partkey") == col("k_part")) & (col("l_suppkey") == col("k_supp"))
    priced = dealt(line, tasks, "l_partkey", "l_suppkey").join(part_rows(spark, sf_dir, tasks), same_pair).drop("k_part", "k_supp")
    return (
        dealt(priced, tasks, "l_orderkey").join(order_rows(spark, sf_dir, tasks), col("l_orderkey") == col("o_orderkey")).drop("o_orderkey")
        .withColumns({"has_other_supplier": other("low", "high"), "other_also_late": other("late_low", "late_high")})
        .drop("low", "high", "late_low", "late_high")
        .join(suppliers, col("l_suppkey") == col("s_suppkey")).drop("s_suppkey")
    )


def wide_columns(df: DataFrame) -> DataFrame:
    """The wide table as the kernels read it; what aggregates of parts' lines tell only where they were asked for."""
    keys = {"o_orderkey": col("l_orderkey"), "c_custkey": col("o_custkey"), "p_partkey": col("l_partkey"),
            "ps_partkey": col("l_partkey"), "ps_suppkey": col("l_suppkey")}
    of_sums = {"avg_quantity": col("part_qty") / col("part_lines"), "ps_availqty": col("part_qty") / col("part_suppliers")}
    return df.withColumns(keys).withColumns(of_line() | of_part() | {
        "l_commitdate_days": col("o_orderdate_days") + COMMIT_DAYS,
        "c_nation": chosen(fx.NATIONS, col("c_nationkey")), "s_nation": chosen(fx.NATIONS, col("s_nationkey")),
        "r_name": col("c_region"), "s_address": F.concat(F.lit("addr_"), col("l_suppkey").cast("string")),
    } | (of_sums if "part_qty" in df.columns else {}))


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole wide table, written once for an application that runs many kernels: each of them then scans its
    few columns of it. It is written anew when a table it is made of has changed, and goes when the application ends."""
    return wide_columns(written(spark, sf_dir, "wide-rows", lambda: wide_plan(spark, sf_dir)))


def is_written(spark: SparkSession, sf_dir: str, name: str) -> tuple | None:
    """The key of what was written of these tables under this name, if it was."""
    key = written_key(spark, sf_dir, name)
    return key if key in _written else None


def written_key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return name, spark.sparkContext.applicationId, *(version(spark, sf_dir, table_name) for table_name in WIDE_FROM)


def written(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """These rows, written once for each version of the tables and read from there."""
    key = written_key(spark, sf_dir, name)
    if key not in _written:
        plan, path = rows(), fresh_folder(spark, name)
        plan.write.option("compression", "zstd").parquet(path)
        _written[key] = path, plan.schema
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


# --- lines with no more than one kernel needs --------------------------------

#: The tables that lines meet for a kernel, in turn. The one that most of its columns come from is last of
#: orders and parts, so that they are not shuffled; suppliers come first where they bring a nation or nothing.
MEETS = {
    **dict.fromkeys(("tpch_q3", "tpch_q4", "tpch_q5", "tpch_q7", "tpch_q10", "tpch_q12"), ("supplier", "part", "orders")),
    **dict.fromkeys(("tpch_q8", "tpch_q9", "tpch_q14", "tpch_q19"), ("supplier", "orders", "part")),
    **dict.fromkeys(("tpch_q2", "tpch_q11", "tpch_q16", "tpch_q17", "tpch_q20", "src_wide_rows"), ("orders", "part", "supplier")),
    **dict.fromkeys(("tpch_q18", "tpch_q21"), ("part", "orders", "supplier")),
}
#: Of which of these tables a kernel reads aggregates of the lines.
SUMS = {
    **dict.fromkeys(("tpch_q11", "tpch_q17", "tpch_q20"), ("part",)),
    **dict.fromkeys(("tpch_q18", "tpch_q21"), ("orders",)),
    "src_wide_rows": ("orders", "part"),
}


def sums_by_part(df: DataFrame) -> DataFrame:
    """The quantity of a line's part and supplier, and the part's quantity, lines and suppliers."""
    quantity, part = F.when(col("once"), col("l_quantity")), Window.partitionBy("l_partkey")
    return df.withColumns({
        "shipped_qty": F.sum(quantity).over(Window.partitionBy("l_partkey", "l_suppkey")),
        "place": F.dense_rank().over(part.orderBy("l_suppkey")),
    }).withColumns({
        "part_qty": F.sum(quantity).over(part), "part_lines": F.sum(col("once").cast("long")).over(part),
        "part_suppliers": F.max("place").over(part),
    }).drop("place")


def sums_by_order(df: DataFrame, orders: DataFrame) -> DataFrame:
    """The total quantity of a line's order, and whether the order has another supplier and another late one: its
    smallest and largest tell. A row per order tells which lines are late, and how often the order is there."""
    order = Window.partitionBy("l_orderkey")
    late = F.when(of_line()["l_receiptdate_days"] > col("first_day") + COMMIT_DAYS, col("l_suppkey"))

    def other(supplier: Column) -> Column:
        low, high = F.min(supplier).over(order), F.max(supplier).over(order)
        return F.when((low != col("l_suppkey")) | (high != col("l_suppkey")), 1).otherwise(0)

    once = orders.groupBy(col("o_orderkey").alias("k_order")).agg(F.count("*").alias("n_orders"), F.min("o_orderdate_days").alias("first_day"))
    return df.join(once.hint("merge"), col("l_orderkey") == col("k_order"), "left").withColumns({
        "order_total_qty": F.sum(F.when(col("once"), col("l_quantity"))).over(order) * col("n_orders"),
        "has_other_supplier": other(col("l_suppkey")), "other_also_late": other(late),
    }).drop("k_order", "n_orders", "first_day")


def lines_met(spark: SparkSession, sf_dir: str, meets: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """A row per line with its order, part and supplier, and aggregates of the lines of an order or part where
    asked for. Lines are shuffled once by order and once by part, and Spark carries no column through that is not read.

    An aggregate is of all lines, so a line that misses a table met before stays until the last one is
    made; of a line that a table has brought more than once, one row is ``once``."""
    tasks = tasks_of_lines(spark, sf_dir)
    large = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sorted_join(rows: DataFrame) -> DataFrame:
        return rows.hint("merge") if large else rows  # of many lines, the other tables are large as well

    def as_lines(rows: DataFrame, own: str) -> DataFrame:
        return rows.repartition(tasks, own) if large else rows  # else lines would be dealt out anew to meet these

    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate_days", days("o_orderdate")).drop("o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # Regions come to suppliers and customers first: else lines and orders would be dealt out by nation to meet them.
    order_rows = orders.join(sorted_join(with_regions(customers, spark, sf_dir, "c")), col("o_custkey") == col("c_custkey"))
    suppliers = table(spark, sf_dir, "supplier").withColumn("is_complaint", F.when(col("s_acctbal") < 0, 1).otherwise(0)).drop("s_acctbal")
    suppliers = with_regions(suppliers, spark, sf_dir, "s")
    if row_count(spark, sf_dir, "supplier") <= SUPPLIERS_SENT:
        suppliers = F.broadcast(suppliers)
    brought = {"orders": ("l_orderkey", "o_orderkey", order_rows), "part": ("l_partkey", "p_partkey", table(spark, sf_dir, "part"))}
    make = {"orders": lambda df: sums_by_order(df, as_lines(orders, "o_orderkey")), "part": sums_by_part}

    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        days("l_shipdate").alias("l_shipdate_days"), F.lit(True).alias("once"), F.lit(True).alias("found"))
    for n, name in enumerate(meets):
        if name == "supplier":
            df = df.join(suppliers, col("l_suppkey") == col("s_suppkey")).drop("s_suppkey")
            continue
        key, own, rows = brought[name]
        if large or name in sums:
            df = df.repartition(tasks, key)
        if name in sums:
            df = make[name](df)
        if not set(sums) & set(meets[n + 1:]):
            df = df.join(sorted_join(rows), col(key) == col(own)).drop(own)
            continue
        rows = as_lines(rows, own).withColumn("copy", F.row_number().over(Window.partitionBy(own).orderBy(own)))
        df = df.join(sorted_join(rows), col(key) == col(own), "left").withColumns({
            "once": col("once") & (F.coalesce("copy", F.lit(1)) == 1), "found": col("found") & col("copy").isNotNull(),
        }).drop(own, "copy")
    return (df.filter("found") if sums else df).drop("once", "found")


def met_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return wide_columns(lines_met(spark, sf_dir, MEETS[name], SUMS.get(name, ())))


def kernel_rows(spark: SparkSession, sf_dir: str, name: str, kernel: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a kernel makes of the wide rows. Where the whole wide table has been written, it is read; else no more
    is joined and shuffled than this kernel needs, and its rows are written once and read from there."""
    if is_written(spark, sf_dir, "wide-rows"):
        return kernel(wide_rows(spark, sf_dir))
    return written(spark, sf_dir, f"rows-{name}", lambda: kernel(met_rows(spark, sf_dir, name)))


def row_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """What the row kernel of this name reads."""
    if name == "tpch_q13":
        return comments(spark, sf_dir)
    if name == "tpch_q22":
        return accounts(spark, sf_dir)
    return lines(spark, sf_dir) if name in OF_LINES else wide_rows(spark, sf_dir)


# --- numeric and payload kernels --------------------------------------------

def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line as an option: the price of a unit against the part's retail price, the days between order
    and shipping, the discount as rate and the tax (at least 1 %) as volatility."""
    joined = with_parts(with_orders(lines(spark, sf_dir), spark, sf_dir), spark, sf_dir)
    return joined.select(
        (col("l_extendedprice") / col("l_quantity")).alias("spot"), col("p_retailprice").alias("strike"),
        ((F.abs(col("l_shipdate_days") - col("o_orderdate_days")) + 1) / 365).alias("time_to_exp"), col("l_discount").alias("risk_free"),
        (col("l_tax") + 0.01).alias("volatility"),
    )


def names(spark: SparkSession, sf_dir: str, wanted: Sequence[str]) -> DataFrame:
    """Lines with those of the names that belong to them: only the tables that hold one are joined."""
    rows = lines(spark, sf_dir)
    if any(c.startswith("p_") for c in wanted):
        rows = with_parts(rows, spark, sf_dir)
    places = {"n_name", "r_name"} & set(wanted)
    if places or "s_name" in wanted:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        if places:
            nation = table(spark, sf_dir, "nation")
            if "r_name" in places:
                nation = nation.join(table(spark, sf_dir, "region"), col("n_regionkey") == col("r_regionkey"))
            suppliers = suppliers.join(nation.select("n_nationkey", *places), col("s_nationkey") == col("n_nationkey"))
        rows = rows.join(suppliers, col("l_suppkey") == col("s_suppkey"))
    return rows.select(*wanted)


def _strings(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        outputs = ["s_in"] if len(columns) == 1 else [f"s_in{n}" for n in range(1, len(columns) + 1)]
        return names(spark, sf_dir, columns).select(*[col(c).alias(o) for c, o in zip(columns, outputs, strict=True)])

    return build


NUMBERS = {"a": "l_quantity", "b": "l_discount", "c": "l_tax", "d": "l_extendedprice", "s_in": "s_name"}


def sums(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return names(spark, sf_dir, [NUMBERS[c] for c in columns]).select(*[col(NUMBERS[c]).alias(c) for c in columns])

    return build


STRINGS16 = ("s_name", "n_name", "r_name", "p_brand", "p_name", "p_type", "p_container", "l_returnflag")
KERNEL_INPUTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "add": lambda s, d: lines(s, d).select(col("l_orderkey").alias("a"), col("l_partkey").alias("b")),
    # Discounts and taxes as a value between -4 and 4.
    "norm_cdf": lambda s, d: lines(s, d).select(
        ((col("l_quantity") - 25.5) / 25.5 * 3 + (col("l_discount") - 0.05) * 20).alias("v")),
    "options": options,
    "str0": sums("a", "b", "c", "d"), "str2": sums("a", "b", "c", "s_in"),
    "str4": _strings("s_name", "n_name"), "str6": _strings("s_name", "n_name", "r_name"),
    "str8": _strings("s_name", "n_name", "r_name", "p_brand"), "str16": _strings(*STRINGS16),
    "len_short": _strings("n_name"), "len_medium": _strings("s_name"),
    "len_long": lambda s, d: table(s, d, "documents").select(col("text").alias("s_in")),
}
