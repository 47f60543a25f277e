"""Global order without a global window: range blocks.

A window over a whole table is one task. Here the order is cut at approximate
quantiles into blocks; each block is a window partition of its own, and what
carries over from block to block goes through a table with one row per block.
A single value that fills many rows stays in one block only where ties must meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on average, and the most blocks: their cut points are literals of the plan.
BLOCK_ROWS, MOST_BLOCKS = 250_000, 2048


def cut_points(df: DataFrame, col: str, blocks: int | None = None) -> list[int]:
    """Ascending cut points of a whole-number column: blocks - 1 at most, without blocks as many as its rows ask for."""
    v = df.select(F.col(col).cast("bigint").alias("v"))
    ask = range(1, MOST_BLOCKS) if blocks is None else range(1, blocks)
    n, q = v.agg(F.count("v"), F.percentile_approx("v", [i / (ask.stop) for i in ask] or [0.5], 10 * MOST_BLOCKS)).first()
    if blocks is None:
        step = max(1, MOST_BLOCKS // max(1, min(MOST_BLOCKS, -(-n // BLOCK_ROWS))))
        q = (q or [])[step - 1 :: step]
    return sorted(set(q or [])) if blocks != 1 else []


def block_of(value: Column, cuts: list[int]) -> Column:
    """Number of cut points below value, by binary search in the plan."""
    v = value.cast("bigint")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > cuts[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    if len(cuts) <= 64:  # a size that generated code takes whole
        return search(0, len(cuts))
    every = len(cuts) // 64 + 1
    coarse = cuts[::every]
    parts = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in cuts[i + 1 : i + every]]).cast("array<bigint>") for i in range(0, len(cuts), every)])
    k = block_of(v, coarse)  # coarse cut points below value
    inside = F.size(F.filter(F.get(parts, k - 1), lambda c: c < v))
    return F.when(k == 0, F.lit(0)).otherwise((k - 1) * every + 1 + inside).cast("int")


def _carried(blocks: DataFrame, value: Column) -> DataFrame:
    """(block, carry) from a table of one row per block: value aggregated over the blocks before."""
    return blocks.select("block", value.over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))


def prefix_sum(df: DataFrame, order: str, value: str, ties: tuple[str, ...] = (), out: str = "prefix", blocks: int | None = None) -> DataFrame:
    """df with the inclusive sum of value in the order of a whole-number column."""
    d = df.withColumn("block", block_of(F.col(order), cut_points(df, order, blocks)))
    carry = _carried(d.groupBy("block").agg(F.sum(value).alias("s")), F.sum("s"))
    w = Window.partitionBy("block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(carry), "block")  # a row per block
    return d.withColumn(out, F.coalesce("carry", F.lit(0)) + F.sum(value).over(w)).drop("block", "carry")


def global_index(df: DataFrame, order: str, ties: tuple[str, ...] = (), out: str = "idx", blocks: int | None = None) -> DataFrame:
    """df with a dense number from 0 in the order of a whole-number column."""
    d = prefix_sum(df.withColumn("one", F.lit(1).cast("bigint")), order, "one", ties, out, blocks)
    return d.withColumn(out, F.col(out) - 1).drop("one")


def delta(df: DataFrame, order: str, value: str, out: str = "delta", blocks: int | None = None) -> DataFrame:
    """df with value minus the one before it in a unique order, the first minus zero."""
    d = df.withColumn("block", block_of(F.col(order), cut_points(df, order, blocks)))
    last = d.groupBy("block").agg(F.max_by(value, order).alias("v"))
    carry = _carried(last, F.last("v"))
    d = d.join(F.broadcast(carry), "block")
    before = F.lag(value).over(Window.partitionBy("block").orderBy(order))
    return d.withColumn(out, F.col(value) - F.coalesce(before, F.col("carry"), F.lit(0))).drop("block", "carry")


def neighbours(values: DataFrame, queries: DataFrame, key: str = "v", at: str = "s", blocks: int | None = None) -> DataFrame:
    """queries with ``below``: the row of values (as a struct) with the greatest key < at, and ``above``: the least key > at.

    An as-of lookup for tables of any size; keys of values must be distinct. Null
    where there is none.
    """
    cuts = cut_points(values, key, blocks)
    row = F.struct(*[F.col(c) for c in values.columns])
    v = values.select(F.col(key).alias("k"), row.alias("row"))
    none = F.lit(None).cast(v.schema["row"].dataType)
    qrow = F.struct(*[F.col(c) for c in queries.columns])
    q = queries.select(F.col(at).alias("k"), qrow.alias("q"))
    both = v.select("k", "row", F.lit(None).cast(q.schema["q"].dataType).alias("q")).union(q.select("k", none.alias("row"), "q"))
    both = both.withColumn("block", block_of(F.col("k"), cuts))
    ends = v.withColumn("block", block_of(F.col("k"), cuts)).groupBy("block").agg(F.max_by("row", "k").alias("hi"), F.min_by("row", "k").alias("lo"))
    every = both.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("block")).join(ends, "block", "left")
    carry = every.select("block", F.last("hi", True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("lower"), F.first("lo", True).over(Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)).alias("upper"))
    # Ranges by key keep an equal key out of both sides. Both frames grow from their start, so a block is read once for each.
    up, down = (Window.partitionBy("block").orderBy(k).rangeBetween(Window.unboundedPreceding, -1) for k in (F.col("k"), F.col("k").desc()))
    both = both.withColumns({"b": F.last("row", True).over(up), "a": F.last("row", True).over(down)})
    found = both.where("q is not null").join(F.broadcast(carry), "block")
    return found.select("q.*", F.coalesce("b", "lower").alias("below"), F.coalesce("a", "upper").alias("above"))
