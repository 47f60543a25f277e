"""Set and multiset similarity: partial aggregates and equi-joins on the element, or arrays of a record at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encoding import clean_bytes
from strandloom.operators import minimizers


def jaccard(a: DataFrame, b: DataFrame, item: str, multiset: bool = False, count: str | None = None) -> DataFrame:
    """One row (i, u, n1, n2, jaccard) for two collections of items, each counted once or by a column.

    As sets, or as multisets with the sums of lesser and greater counts. Both empty: null.
    """
    one = F.col(count) if multiset and count else F.lit(1)
    tagged = a.select(F.col(item).alias("x"), one.alias("p"), F.lit(0).alias("q")).union(b.select(F.col(item).alias("x"), F.lit(0).alias("p"), one.alias("q")))
    if multiset:
        c = tagged.groupBy("x").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    else:
        c = tagged.groupBy("x").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    s = c.agg(*[F.coalesce(F.sum(e), F.lit(0)).cast("bigint").alias(n) for n, e in (("i", F.least("p", "q")), ("u", F.greatest("p", "q")), ("n1", F.col("p")), ("n2", F.col("q")))])
    return s.withColumn("jaccard", ratio(F.col("i"), F.col("u")))


def ratio(i: Column, u: Column) -> Column:
    return F.round(F.try_divide(i.cast("double"), u.cast("double")), 9)


def pair_jaccard(items: DataFrame, pairs: DataFrame, group: str, item: str, multiset: bool = False) -> DataFrame:
    """(a, b, i, u, n1, n2, jaccard) for given pairs (a, b) of groups.

    Counts per (group, item) come first, so neither a frequent item nor a long
    group multiplies; a pair's items meet by an equi-join on (pair, item).
    """
    c = items.groupBy(F.col(group).alias("g"), F.col(item).alias("x")).agg(F.count("*").alias("c"))
    if not multiset:
        c = c.withColumn("c", F.lit(1).cast("bigint"))
    size = c.groupBy("g").agg(F.sum("c").alias("n"))
    left = pairs.join(c, F.col("a") == F.col("g")).select("a", "b", "x", F.col("c").alias("ca"))
    right = c.select(F.col("g").alias("b"), "x", F.col("c").alias("cb"))
    both = left.join(right, ["b", "x"]).groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("i"))
    out = pairs.join(both, ["a", "b"], "left")
    out = out.join(size.select(F.col("g").alias("a"), F.col("n").alias("n1")), "a", "left").join(size.select(F.col("g").alias("b"), F.col("n").alias("n2")), "b", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("i", "n1", "n2")})
    out = out.withColumn("u", F.col("n1") + F.col("n2") - F.col("i"))
    return out.select("a", "b", "i", "u", "n1", "n2", ratio(F.col("i"), F.col("u")).alias("jaccard"))


def record_jaccard(collections: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, i, u, n1, n2, jaccard) for given pairs (a, b) of records; collections: (rec, values, counts), values ascending.

    What is local to a record stays in its row: a record's items are shuffled once for
    each side of its pairs, as two arrays, and a pair's arrays are intersected in a task.
    A pair's record without a row is empty.
    """
    kind_a, kind_b = (pairs.schema[c].dataType.simpleString() for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "i", "n1", "n2"]
        none = np.zeros(0, np.int64)

        def arrays(col: pa.Array) -> list[np.ndarray]:
            return [none if not v.is_valid else v.values.to_numpy(zero_copy_only=False) for v in col]

        for b in batches:
            out: list[list[int]] = [[], [], []]
            for v, c, w, d in zip(*(arrays(b.column(k)) for k in range(2, 6))):
                at = np.searchsorted(w, v)
                same = at < len(w)
                same[same] = w[at[same]] == v[same]
                out[0].append(int(np.minimum(c[same], d[at[same]]).sum()))
                out[1].append(int(c.sum()))
                out[2].append(int(d.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in out]], names)

    side = lambda at: collections.select(F.col("rec").alias(at), F.col("values").alias(f"v_{at}"), F.col("counts").alias(f"c_{at}"))
    j = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "v_a", "c_a", "v_b", "c_b")
    out = j.mapInArrow(run, f"a {kind_a}, b {kind_b}, i bigint, n1 bigint, n2 bigint").withColumn("u", F.col("n1") + F.col("n2") - F.col("i"))
    return out.select("a", "b", "i", "u", "n1", "n2", ratio(F.col("i"), F.col("u")).alias("jaccard"))


def split_repeated(df: DataFrame, rec: str = "rec") -> tuple[DataFrame, DataFrame | None]:
    """(rows whose record is in no other row, the other rows or None if there are none); reads the column at once."""
    many = df.groupBy(rec).agg(F.count("*").alias("n")).where("n > 1").select(F.col(rec).alias("repeated"))
    if many.isEmpty():
        return df, None
    same = F.col(rec).eqNullSafe(F.col("repeated"))
    return df.join(many, same, "left_anti"), df.join(many, same, "left_semi")


def _overlap(a: np.ndarray, b: np.ndarray, multiset: bool) -> tuple[int, int, int]:
    """(i, n1, n2) of two collections of k-mers of fewer than 64 bits."""
    if not multiset:
        a, b = _ascending_set(a), _ascending_set(b)
        both = np.sort(np.concatenate([a, b]))
        return int(np.count_nonzero(both[1:] == both[:-1])), len(a), len(b)
    one = a.dtype.type(1)
    s = np.sort(np.concatenate([a << one, (b << one) | one]))
    last = np.flatnonzero(np.append((s[1:] ^ s[:-1]) > one, True))[: len(s)]
    more = np.diff(np.cumsum(1 - 2 * (s & one).astype(np.int64))[last], prepend=0)  # in a than in b, of each value
    return (len(s) - int(np.abs(more).sum())) // 2, len(a), len(b)


def _ascending_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def sequence_jaccard(df: DataFrame, pairs: DataFrame, k: int, canonical: bool = False, multiset: bool = False, rec: str = "rec", seq: str = "seq", read=clean_bytes) -> DataFrame:
    """(a, b, i, u, n1, n2, jaccard) of the k-mers, k up to 31, of given pairs (a, b) of records.

    Sequences are shuffled, once for each side of their pairs, not their k-mers, which take several
    times the bytes; they are packed where a pair has met. Texts of a record with several rows are
    one with line feeds between them, which break. A pair's record without a row is empty.
    """
    kind_a, kind_b = (pairs.schema[c].dataType.simpleString() for c in ("a", "b"))
    once, several = split_repeated(df.select(F.col(rec).alias("rec"), F.col(seq).alias("seq")))
    if several is not None:
        once = once.unionByName(several.groupBy("rec").agg(F.concat_ws("\n", F.collect_list("seq")).alias("seq")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = minimizers.kmer_arrays(k, canonical, read)
        for b in (part for whole in batches for part in (whole.slice(i, 256) for i in range(0, len(whole), 256))):
            found = [_overlap(x, y, multiset) for x, y in zip(arrays(b.column(2)), arrays(b.column(3)))]
            out = [pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], ["a", "b", "i", "n1", "n2"])

    side = lambda at: once.select(F.col("rec").alias(at), F.col("seq").cast("binary").alias(f"s_{at}"))
    j = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "s_a", "s_b")
    out = j.mapInArrow(run, f"a {kind_a}, b {kind_b}, i bigint, n1 bigint, n2 bigint").withColumn("u", F.col("n1") + F.col("n2") - F.col("i"))
    return out.select("a", "b", "i", "u", "n1", "n2", ratio(F.col("i"), F.col("u")).alias("jaccard"))


def distinct_kmers(df: DataFrame, k: int, canonical: bool = False, rec: str = "rec", seq: str = "seq", read=clean_bytes) -> DataFrame:
    """(rec, distinct_kmers): in a row's own task, and by a shuffle of k-mers for records with several rows only."""
    once, several = split_repeated(df.select(F.col(rec).alias("rec"), F.col(seq).alias("seq")))
    out = minimizers.distinct_in_row(once, k, canonical, read=read)
    if several is None:
        return out
    rest = unique(minimizers.packed_kmers(several, k, canonical, read=read), "rec", "value")
    return out.unionByName(rest.groupBy("rec").agg(F.count("*").alias("distinct_kmers")))


def all_pairs_jaccard(items: DataFrame, group: str, item: str, multiset: bool = False) -> DataFrame:
    """(a, b, i, u, n1, n2, jaccard) of all pairs a < b of groups that share an item.

    An inverted index: groups meet by an equi-join on the item, after counts per (group,
    item), so the work is that of the shared items and no pair is made without one.
    """
    c = items.groupBy(F.col(group).alias("g"), F.col(item).alias("x")).agg(F.count("*").alias("c"))
    if not multiset:
        c = c.withColumn("c", F.lit(1).cast("bigint"))
    size = c.groupBy("g").agg(F.sum("c").alias("n"))
    left, right = c.select(F.col("g").alias("a"), "x", F.col("c").alias("ca")), c.select(F.col("g").alias("b"), "x", F.col("c").alias("cb"))
    both = left.join(right, "x").where("a < b").groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).cast("bigint").alias("i"))
    out = both.join(size.select(F.col("g").alias("a"), F.col("n").alias("n1")), "a").join(size.select(F.col("g").alias("b"), F.col("n").alias("n2")), "b")
    out = out.withColumn("u", F.col("n1") + F.col("n2") - F.col("i"))
    return out.select("a", "b", "i", "u", "n1", "n2", ratio(F.col("i"), F.col("u")).alias("jaccard"))


def set_union(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    return a.select(item).union(b.select(item)).distinct()


def unique(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values: what collapsing equal neighbours of a sorted sequence leaves."""
    return df.select(*cols).distinct()
