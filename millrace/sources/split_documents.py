"""Benchmark-result documents of any size: one document is read by as many tasks as Spark splits its file for.

The text source splits a file at a separator, here the opening brace, so a document
becomes fragments, in order within each split. Whether a fragment begins inside a
string, how deep it is and to which member of the document it belongs are running
sums over the fragments before it: sums by split are put together first, one row per
split, and within a split it is a window. The members (a benchmark, a run of a lone
benchmark, the document's metadata) are then put together and parsed by Spark. Tables
of a row per split, document or file are written before they are joined, so that Spark
knows that they are small and leaves the fragments and members where they are.

Defined cases: files without a brace give no rows; braces, quotes and escapes in
strings are text; members of other keys are skipped. A member is one row, as a
line is elsewhere, so a single benchmark should stay below 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bench_results import _NAME, _RUNS
from .workspace import fresh_folder

col = F.col

_MEMBER = f"name string, metadata {_NAME}, runs {_RUNS}, values array<double>"
_SPLIT = ["document", "split"]


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that they are computed once and stay what they are."""
    folder = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _earlier(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A row per split: the sum of ``value`` over all splits of the document before it. Kept, and so known to
    be small: the fragments that it is joined to stay where they are."""
    splits = rows.groupBy(*_SPLIT).agg(F.sum(value.cast("long")).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("document").orderBy("split")) - col("_sum")
    return _kept(splits.select(*_SPLIT, earlier.alias(name)), "splits")


def _within(value: Column) -> Column:
    """The sum of ``value`` over the fragments of a split before each."""
    value = value.cast("long")
    return F.sum(value).over(Window.partitionBy(*_SPLIT).orderBy("place")) - value


def _bare() -> Column:
    return F.regexp_replace("text", r"(?s)\\.", "")


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, place, text): the text after each opening brace, up to the next, and what stands before
    a file's first."""
    return spark.read.option("lineSep", "{").text(path).select(
        F.struct("_metadata.file_path", "_metadata.file_name").alias("file"), col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), col("value").alias("text"))


def members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, member, key, text): objects that stand directly in a document, or in a list that does, in their
    order, under the key they or their list have. What follows an object in ``text`` is not part of it.
    Fragments are shuffled by split for what depends on quotes, for members, and by member; a file's number
    goes with them, which is the first place in it."""
    read = _kept(fragments(spark, path).withColumn("odd", _count(_bare(), '"') % 2), "fragments")
    files = _kept(read.groupBy("file").agg(F.min("place").alias("document")), "files")
    rows = read.join(files, "file").drop("file")
    rows = rows.join(_earlier(rows, col("odd"), "quotes"), _SPLIT).withColumn("inside", (_within(col("odd")) + col("quotes")) % 2 == 1)
    # The end of a string that began before, and the beginning of one that goes on, are strings too. The key
    # of an object stands at the end of the text before it.
    said = F.when(col("inside"), F.concat(F.lit('"'), _bare())).otherwise(_bare())
    closes = _count(F.regexp_replace("said", r'"[^"]*("|$)', ""), "}").cast("long")
    rows = rows.withColumn("said", said).select(
        *_SPLIT, "place", "text", (~col("inside")).cast("long").alias("opens"), closes.alias("closes"),
        F.regexp_extract("said", r'"([^"]*)"\s*:\s*\[?\s*$', 1).alias("key"))
    # All fragments count as opened by a brace, a file's first one too: all that follows is one level deeper.
    deeper = col("opens") - col("closes")
    rows = _kept(rows.withColumn("depth", _within(deeper)), "marks")
    rows = rows.join(_earlier(rows, deeper, "above"), _SPLIT).withColumn("depth", col("depth") + col("above"))
    starts = ((col("opens") == 1) & (col("depth") == 2)).cast("long")
    ends = col("depth") + deeper == 2
    rows = rows.select(*_SPLIT, "place", "text", starts.alias("starts"), F.when(ends, col("key")).alias("key"))
    rows = rows.join(_earlier(rows, col("starts"), "earlier"), _SPLIT).withColumn(
        "member", col("earlier") + _within(col("starts")) + col("starts"))
    whole = rows.groupBy("document", "member").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "place", "text"))), lambda x: x["text"]), "{").alias("text"),
        F.max_by("key", F.struct("split", "place")).alias("next_key"),
    )
    whole = _kept(whole, "members")
    keys = whole.filter("next_key <> ''").groupBy("document").agg(  # as many as a document has keys
        F.array_sort(F.collect_list(F.struct((col("member") + 1).alias("at"), col("next_key").alias("key")))).alias("keys"))
    keys = _kept(keys, "keys")
    of = F.element_at(F.filter("keys", lambda k: k["at"] <= col("member")), -1)["key"]
    return whole.filter("member > 0").join(keys, "document").join(files, "document").select(
        "file", "member", of.alias("key"), F.concat(F.lit("{"), "text").alias("text"))


def write_large_results(measured: DataFrame, path: str, most: int) -> None:
    """Write (benchmark, value, seq) as documents of a list of about ``most`` benchmarks each, a line for each,
    whose names are in turn their own and that of their run. A document is written by one task."""
    documents = -(-max(measured.count(), 1) // most)
    name, no_name = F.struct(col("benchmark").alias("name")), F.lit(None).cast(_NAME)
    own = col("seq") % 2 == 0
    run = F.struct(F.when(own, no_name).otherwise(name).alias("metadata"), F.array("value").alias("values"))
    entry = F.struct(F.when(own, name).otherwise(no_name).alias("metadata"), F.array(run).alias("runs"))
    number = F.pmod(F.xxhash64("seq"), F.lit(documents)).cast("int")
    lines = measured.select(number.alias("document"), F.lit(1).alias("place"), F.concat(F.to_json(entry), F.lit(",")).alias("value"))
    each = measured.sparkSession.range(documents).select(col("id").cast("int").alias("document"))
    for place, text in ((0, '{"version": "1.0", "benchmarks": ['), (2, '{"runs": []}]}')):
        lines = lines.unionByName(each.select("document", F.lit(place).alias("place"), F.lit(text).alias("value")))
    lines.repartitionById(documents, "document").sortWithinPartitions("place").select("value").write.text(path)


def read_large_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, benchmark, value), as ``read_bench_results`` has them for files of one document each."""
    parsed = members(spark, path).filter(col("key").isin("benchmarks", "runs", "metadata")).select(
        "file", "member", "key", F.from_json("text", _MEMBER).alias("m"))
    of_file = parsed.groupBy("file").agg(
        F.max(col("key") == "benchmarks").alias("listed"),
        F.max(F.when(col("key") == "metadata", col("m.name"))).alias("document_name"),
        F.min_by("m.metadata.name", F.when((col("key") == "runs") & col("m.metadata.name").isNotNull(), col("member"))).alias("run_name"),
    )
    of_file = _kept(of_file, "of-file")
    names = F.filter(F.transform("m.runs", lambda run: run["metadata"]["name"]), lambda n: n.isNotNull())
    own = F.coalesce("m.metadata.name", F.get(names, F.lit(0)), "document_name")
    alone = F.coalesce("document_name", "run_name", F.lit("unknown"))
    runs = F.when(col("key") == "benchmarks", F.transform("m.runs", lambda run: run["values"])).when(
        (col("key") == "runs") & ~col("listed"), F.array("m.values"))
    return parsed.join(of_file, "file").select(
        col("file.file_name").alias("file"), F.when(col("listed"), own).otherwise(alone).alias("benchmark"),
        F.explode(F.flatten(F.filter(runs, lambda r: r.isNotNull()))).alias("value"),
    ).filter(col("benchmark").isNotNull())
