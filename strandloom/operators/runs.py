"""Runs, neighbours and running views of sequences, each sequence a window partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(F.col(value))).over(w)
    return df.withColumn("change", F.when(before.isNull() | ~before[value].eqNullSafe(F.col(value)), 1).otherwise(0))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, start, symbol, length): maximal runs of equal neighbours, start counted in elements. Nulls equal nulls."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = _changes(df, keys, order, value).withColumns({"i": F.row_number().over(w) - 1, "run": F.sum("change").over(w)})
    runs = d.groupBy(*keys, "run").agg(F.min("i").cast("bigint").alias("start"), F.first(value).alias("symbol"), F.count("*").alias("length"))
    return runs.drop("run")


def expand_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, symbol): the elements that runs stand for."""
    d = runs.select(*keys, "symbol", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("j"))
    return d.select(*keys, (F.col("start") + F.col("j")).alias("i"), "symbol")


def unique_neighbours(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    return _changes(df, keys, order, value).where("change = 1").drop("change")


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "prefix") -> DataFrame:
    """Inclusive prefix sums within each sequence."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def differences(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "delta") -> DataFrame:
    """Each value minus the one before, the first minus zero."""
    return df.withColumn(out, F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy(*keys).orderBy(*order)))


def indexed(df: DataFrame, keys: list[str], order: list[str], out: str = "i") -> DataFrame:
    """Elements with their index in the sequence."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def append(*parts: DataFrame, out: str = "part") -> DataFrame:
    """Parts one after another, with the ordinal of each row's part; empty parts give nothing."""
    return reduce(DataFrame.unionByName, [p.withColumn(out, F.lit(i)) for i, p in enumerate(parts)])


def sliding(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Sum, least, greatest and last of the latest ``size`` values at each element."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)
    return df.withColumns({"window_sum": F.sum(value).over(w), "window_min": F.min(value).over(w), "window_max": F.max(value).over(w), "window_last": F.last(value).over(w)})


def sliding_minima(df: DataFrame, keys: list[str], order: str, hashed: str, size: int, dedup: bool = True) -> DataFrame:
    """Least-hashed element (leftmost of ties) of each ``size`` consecutive ones, by unsigned hash.

    (keys, order, hash) rows of the elements that are least, once for each change
    with dedup, else once per window. A null hash breaks the sequence.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("segment", F.sum(F.when(F.col(hashed).isNull(), 1).otherwise(0)).over(by)).where(F.col(hashed).isNotNull())
    seg = Window.partitionBy(*keys, "segment").orderBy(order)
    frame = seg.rowsBetween(1 - size, 0)
    least = F.min(F.struct(F.col(hashed).bitwiseXOR(F.lit(-(1 << 63))).alias("u"), F.col(order).alias("at"), F.col(hashed).alias("h"))).over(frame)
    d = d.withColumns({"least": least, "n": F.count("*").over(frame)}).where(F.col("n") == size)
    d = d.withColumn("new", F.coalesce(F.lag("least.at").over(seg) != F.col("least.at"), F.lit(True)))
    d = d.where("new") if dedup else d
    return d.select(*keys, F.col("least.at").alias(order), F.col("least.h").alias("hash"))


def external_sort(df: DataFrame, order: list[str], path: str, out: str = "idx") -> DataFrame:
    """df with its place in the whole order, from 0, through sorted runs on disk.

    Ranges of the order are sorted each in a task and written to ``path``, which all
    tasks must reach; a range's start is the number of rows in the ranges before it, a
    table with a row per range. No task holds more than a range.
    """
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order)
    runs.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("run", F.shiftright("at", 33))
    starts = rows.groupBy("run").count()
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = starts.select("run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rows = rows.join(F.broadcast(starts), "run")
    return rows.withColumn(out, F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("run", "at", "start")


def replay(df: DataFrame, pushed: str, path: str) -> DataFrame:
    """Rows as they were pushed, from disk: the unsorted counterpart of ``external_sort``, with idx."""
    return external_sort(df, [pushed], path)


def ends(df: DataFrame, order: str, value: str) -> DataFrame:
    """(front, back): the values of the first and the last row; null if there is none."""
    return df.agg(F.min_by(value, order).alias("front"), F.max_by(value, order).alias("back"))


def counting(spark, start: int, stop: int, step: int = 1) -> DataFrame:
    """(i): whole numbers from start, stop excluded."""
    return spark.range(start, stop, step).select(F.col("id").alias("i"))


def pretty(values: Column) -> Column:
    """An array as text: [a, b, c]."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", ", "null"), F.lit("]"))


def type_names(df: DataFrame) -> DataFrame:
    """(position, name, type) of each column."""
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def sorted_prefix(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of the sorted table, by a bounded heap per task."""
    return df.orderBy(*order).limit(n)
