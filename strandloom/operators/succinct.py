"""Bit vectors, packed integers, rank and select, Elias-Fano sequences as tables.

Rank, select and predecessor search are order statistics of the ones, so each is
a lookup by range blocks (see ``ordered``) and grows with the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bits import low_mask, msb
from strandloom.operators.ordered import delta, global_index, neighbours, prefix_sum


def bit_words(ones: DataFrame, pos: str = "pos") -> DataFrame:
    """(block_idx, word): 64-bit words with ones at the given positions, lowest bit first; zero words are left out."""
    d = ones.select((F.floor(F.col(pos) / 64)).cast("bigint").alias("block_idx"), F.expr(f"shiftleft(1L, cast(pmod({pos}, 64) as int))").alias("bit"))
    return d.groupBy("block_idx").agg(F.bit_or("bit").alias("word"))


def one_positions(words: DataFrame) -> DataFrame:
    """(pos): positions of the ones."""
    d = words.select("block_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where("getbit(word, i) = 1")
    return d.select((F.col("block_idx") * 64 + F.col("i")).alias("pos"))


def bits_at(words: DataFrame, queries: DataFrame, pos: str = "pos") -> DataFrame:
    """queries with ``bit`` at their position."""
    q = queries.withColumn("block_idx", F.floor(F.col(pos) / 64).cast("bigint"))
    return q.join(words, "block_idx", "left").withColumn("bit", F.coalesce(F.expr(f"getbit(word, cast(pmod({pos}, 64) as int))"), F.lit(0)).cast("int")).drop("block_idx", "word")


def all_ones(spark, size: int) -> DataFrame:
    """Words of a vector of ``size`` ones; the last is masked."""
    d = spark.range(-(-size // 64)).select(F.col("id").alias("block_idx"))
    return d.withColumn("word", low_mask(F.least(F.lit(size) - F.col("block_idx") * 64, F.lit(64))).cast("bigint"))


def vector_sizes(words: DataFrame, n: int | None = None) -> DataFrame:
    """(size, size1, size0) of a vector of n bits; without n, of one that ends with its last one."""
    ones = F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("bigint")
    last = F.max(F.when(F.col("word") != 0, F.col("block_idx") * 64 + msb(F.col("word"))))
    size = F.coalesce(last + 1, F.lit(0)) if n is None else F.lit(n)
    return words.agg(size.cast("bigint").alias("size"), ones.alias("size1"), (size - ones).cast("bigint").alias("size0"))


def walk(words: DataFrame, n: int | Column) -> DataFrame:
    """(pos, bit): every bit of words, zeros included, that lies before n."""
    d = words.select("block_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    d = d.select((F.col("block_idx") * 64 + F.col("i")).alias("pos"), F.expr("getbit(word, i)").cast("int").alias("bit"))
    return d.where(F.col("pos") < n)


def _masked(words: DataFrame, masks: DataFrame) -> DataFrame:
    """Words with the bits of ``clear`` taken away and those of ``put`` added; masks: (block_idx, clear, put)."""
    d = words.join(masks, "block_idx", "full_outer")
    w = F.coalesce("word", F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce("clear", F.lit(0)))).bitwiseOR(F.coalesce("put", F.lit(0)))
    return d.select("block_idx", w.alias("word")).where("word <> 0")


def update_bits(words: DataFrame, updates: DataFrame, pos: str = "pos", bit: str = "bit", at: str = "at") -> DataFrame:
    """Words after bits were set (bit 1) or cleared (bit 0), in the order of ``at``: a position's last update counts."""
    last = updates.groupBy(F.col(pos).alias("pos")).agg(F.max_by(bit, at).alias("bit"))
    one = F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")
    masks = last.groupBy(F.floor(F.col("pos") / 64).cast("bigint").alias("block_idx")).agg(F.bit_or(F.when(F.col("bit") == 0, one).otherwise(F.lit(0))).alias("clear"), F.bit_or(F.when(F.col("bit") != 0, one).otherwise(F.lit(0))).alias("put"))
    return _masked(words, masks)


def resize(words: DataFrame, n: int, to: int, fill: int = 0) -> DataFrame:
    """Words of a vector of n bits after it got ``to`` bits; new bits are ``fill``. pop is a resize to n - 1."""
    if n < 0 or to < 0:
        raise ValueError("a vector has no fewer than 0 bits")
    keep = low_mask(F.greatest(F.least(F.lit(to) - F.col("block_idx") * 64, F.lit(64)), F.lit(0))).cast("bigint")
    cut = words.select("block_idx", F.col("word").bitwiseAND(keep).alias("word")).where("word <> 0")
    if not fill or to <= n:
        return cut
    first, last = n // 64, (to - 1) // 64
    new = words.sparkSession.range(first, last + 1).select(F.col("id").alias("block_idx"))
    upto = lambda x: low_mask(F.greatest(F.least(F.lit(x) - F.col("block_idx") * 64, F.lit(64)), F.lit(0))).cast("bigint")
    new = new.select("block_idx", F.lit(0).cast("bigint").alias("clear"), upto(to).bitwiseXOR(upto(n)).alias("put"))
    return _masked(cut, new)


def append_blocks(words: DataFrame, n: int, items: DataFrame, width: int, idx: str = "i", value: str = "x") -> DataFrame:
    """Words of a vector of n bits after the low ``width`` bits of each value were pushed, lowest first, in the order of idx from 0."""
    if not 0 < width <= 64:
        raise ValueError("a width lies between 1 and 64")
    at = F.lit(n) + F.col(idx) * width
    d = items.select(F.floor(at / 64).cast("bigint").alias("b"), (at % 64).cast("int").alias("o"), F.col(value).bitwiseAND(low_mask(F.lit(width)).cast("bigint")).alias("x"))
    low = F.struct(F.col("b").alias("block_idx"), F.expr("shiftleft(x, o)").alias("put"))
    high = F.struct((F.col("b") + 1).alias("block_idx"), F.expr("case when o > 0 then shiftrightunsigned(x, 64 - o) else 0L end").alias("put"))
    d = d.select(F.explode(F.array(low, high)).alias("p")).select("p.*").groupBy("block_idx").agg(F.bit_or("put").alias("put"))
    return _masked(words, d.select("block_idx", F.lit(0).cast("bigint").alias("clear"), "put"))


def rank_between(ones: DataFrame, queries: DataFrame, pos: str = "pos", start: str = "start", stop: str = "stop") -> DataFrame:
    """queries with rank1 and rank0: ones and zeros from start to stop, stop excluded; a range that runs backwards raises."""
    ok = F.when(F.col(stop) >= F.col(start), F.col(stop)).otherwise(F.raise_error(F.lit("a range runs backwards")))
    up = rank(ones, queries.withColumn(stop, ok), pos, stop).withColumnRenamed("rank1", "upto").drop("rank0")
    d = rank(ones, up, pos, start)
    r = F.col("upto") - F.col("rank1")
    return d.withColumns({"rank1": r, "rank0": F.col(stop) - F.col(start) - r}).drop("upto")


def rank(ones: DataFrame, queries: DataFrame, pos: str = "pos", at: str = "i") -> DataFrame:
    """queries with rank1 and rank0: ones and zeros strictly before a position."""
    found = neighbours(global_index(ones.select(F.col(pos).cast("bigint").alias("v")), "v"), queries, "v", at)
    r = F.coalesce(F.col("below.idx") + 1, F.lit(0))
    return found.withColumns({"rank1": r, "rank0": F.col(at) - r}).drop("below", "above")


def select(ones: DataFrame, queries: DataFrame, pos: str = "pos", th: str = "j") -> DataFrame:
    """queries with select1 and select0: positions of the th-th one (null past the last) and zero, from 0.

    The zeros before the k-th one number pos - k, so the j-th zero lies at j plus
    the ones with pos - k <= j.
    """
    index = global_index(ones.select(F.col(pos).cast("bigint").alias("v")), "v")
    q = queries.join(index.select(F.col("idx").alias(th), F.col("v").alias("select1")), th, "left")
    zeros = index.groupBy((F.col("v") - F.col("idx")).alias("v")).agg((F.max("idx") + 1).alias("ones"))
    found = neighbours(zeros, q.withColumn("next", F.col(th) + 1), "v", "next")
    return found.withColumn("select0", F.col(th) + F.coalesce("below.ones", F.lit(0))).drop("below", "above", "next")


def pack_words(items: DataFrame, width: int, idx: str = "i", value: str = "x") -> DataFrame:
    """(block_idx, word): values of ``width`` bits one after another, highest bit first in a word.

    A value that doesn't fit, or a width over 64, raises.
    """
    if not 0 < width <= 64:
        raise ValueError("a width lies between 1 and 64")
    fits = F.shiftrightunsigned(F.col(value), width) == 0 if width < 64 else F.lit(True)
    off = (F.col(idx) * width) % 64
    d = items.select(F.floor(F.col(idx) * width / 64).cast("bigint").alias("b"), off.cast("int").alias("o"), F.when(fits, F.col(value)).otherwise(F.raise_error(F.lit(f"a value exceeds {width} bits"))).alias("x"))
    room = 64 - F.col("o") - width
    first = F.when(room >= 0, F.expr(f"shiftleft(x, greatest(0, 64 - o - {width}))")).otherwise(F.expr(f"shiftrightunsigned(x, greatest(0, o + {width} - 64))"))
    parts = F.array(F.struct(F.col("b").alias("block_idx"), first.alias("part")), F.struct((F.col("b") + 1).alias("block_idx"), F.when(room < 0, F.expr(f"shiftleft(x, least(63, 128 - o - {width}))")).alias("part")))
    d = d.select(F.explode(parts).alias("p")).select("p.*").where("part is not null")
    return d.groupBy("block_idx").agg(F.bit_or("part").alias("word"))


def unpack_words(words: DataFrame, indices: DataFrame, width: int, idx: str = "i") -> DataFrame:
    """indices with ``x``: the value at each."""
    q = indices.withColumns({"b": F.floor(F.col(idx) * width / 64).cast("bigint"), "o": ((F.col(idx) * width) % 64).cast("int")})
    q = q.join(words.select(F.col("block_idx").alias("b"), F.col("word").alias("w0")), "b").join(words.select((F.col("block_idx") - 1).alias("b"), F.col("word").alias("w1")), "b", "left")
    whole = F.expr(f"shiftrightunsigned(w0, greatest(0, 64 - o - {width}))")
    split = F.expr(f"shiftleft(w0, greatest(0, o + {width} - 64)) | shiftrightunsigned(coalesce(w1, 0L), least(63, 128 - o - {width}))")
    x = F.when(F.col("o") + width <= 64, whole).otherwise(split)
    return q.withColumn("x", x.bitwiseAND(low_mask(F.lit(width)).cast("bigint"))).drop("b", "o", "w0", "w1")


def update_packed(words: DataFrame, updates: DataFrame, width: int, idx: str = "i", value: str = "x") -> DataFrame:
    """Packed words after the values at distinct indices were replaced."""
    ones = pack_words(updates.withColumn(value, low_mask(F.lit(width)).cast("bigint")), width, idx, value)
    new = pack_words(updates, width, idx, value)
    masks = ones.withColumnRenamed("word", "clear").join(new.withColumnRenamed("word", "put"), "block_idx")
    d = words.join(masks, "block_idx", "left")
    return d.select("block_idx", F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("clear", F.lit(0)))).bitwiseOR(F.coalesce("put", F.lit(0))).alias("word"))


def rank_overhead(words: DataFrame, n: int | None = None) -> DataFrame:
    """(bits, index_bits, overhead): a rank directory of two 64-bit counts for each 512 bits, against the vector."""
    size = vector_sizes(words, n)
    blocks = F.ceil(F.col("size") / 512)
    return size.select(F.col("size").alias("bits"), (blocks * 128).cast("bigint").alias("index_bits"), F.round(F.try_divide((blocks * 128).cast("double"), F.col("size").cast("double")), 9).alias("overhead"))


def value_runs(values: DataFrame, value: str = "v") -> DataFrame:
    """(v, first, last): each distinct value of a sequence in ascending order and the indices that it fills.

    Counts come first, so a frequent value is a row like any other, whatever task its elements lie in.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("n"))
    p = prefix_sum(counts, "v", "n")
    return p.select("v", (F.col("prefix") - F.col("n")).alias("first"), (F.col("prefix") - 1).alias("last"))


def elias_fano(values: DataFrame, value: str = "v", order: str | None = None) -> DataFrame:
    """(idx, v) of an ascending sequence; with ``order``, a sequence that isn't ascending raises."""
    if order is None:
        return value_runs(values, value).select(F.explode(F.sequence("first", "last")).alias("idx"), "v")
    d = global_index(values.select(F.col(order).alias("o"), F.col(value).cast("bigint").alias("v")), "o")
    d = delta(d, "idx", "v", "step")
    return d.select("idx", F.when(F.col("step") >= 0, F.col("v")).otherwise(F.raise_error(F.lit("the sequence isn't ascending"))).alias("v"))


def elias_fano_size(seq: DataFrame) -> DataFrame:
    """(n, universe, low_bits, bits): what the high unary and low packed parts of a sequence take."""
    s = seq.agg(F.count("*").alias("n"), F.max("v").alias("universe"))
    q = F.floor(F.col("universe") / (F.col("n") + 1))
    low = F.when(q > 1, F.length(F.bin((q - 1).cast("bigint")))).otherwise(0).cast("bigint")
    s = s.withColumn("low_bits", low)
    high = F.call_function("shiftrightunsigned", F.col("universe"), F.col("low_bits").cast("int")) + F.col("n") + 1
    return s.withColumn("bits", (F.col("n") * F.col("low_bits") + high).cast("bigint"))


def elias_fano_at(seq: DataFrame, queries: DataFrame, idx: str = "i") -> DataFrame:
    """queries with value and diff (the step from the value before, the first from 0); null past the ends."""
    d = delta(seq, "idx", "v", "diff")
    return queries.join(d.select(F.col("idx").alias(idx), F.col("v").alias("value"), "diff"), idx, "left")


def _runs(seq: DataFrame) -> DataFrame:
    if "first" in seq.columns:
        return seq
    return seq.groupBy("v").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def _count(seq: DataFrame) -> DataFrame:
    n = F.coalesce(F.max("last") + 1, F.lit(0)) if "first" in seq.columns else F.count("*")
    return seq.agg(n.alias("n"))


def find_less(seq: DataFrame, queries: DataFrame, at: str = "s", ignore_duplicates: bool = False) -> DataFrame:
    """queries with ``found``: index of the last element < s, or the first of its equals; -1 if none. seq: elements or ``value_runs``."""
    found = neighbours(_runs(seq), queries, "v", at)
    side: Column = F.col("below.first") if ignore_duplicates else F.col("below.last")
    return found.withColumn("found", F.coalesce(side, F.lit(-1).cast("bigint"))).drop("below", "above")


def find_greater(seq: DataFrame, queries: DataFrame, at: str = "s", ignore_duplicates: bool = False) -> DataFrame:
    """queries with ``found``: index of the first element > s, or the last of its equals; n if none. seq: elements or ``value_runs``."""
    found = neighbours(_runs(seq), queries, "v", at).join(F.broadcast(_count(seq)), how="cross")  # one row
    side: Column = F.col("above.last") if ignore_duplicates else F.col("above.first")
    return found.withColumn("found", F.coalesce(side, F.col("n"))).drop("below", "above", "n")
