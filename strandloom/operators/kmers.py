"""k-mers of nucleotide sequences.

Windows are byte slices of the cleaned sequence and of its reverse complement,
which is made once per record: each costs a copy of k bytes, wherever it lies,
and the plan is a projection and a generator without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.encoding import clean, reverse_complement


def parameters(k: int, m: int | None = None, canonical: bool = False) -> dict[str, int | bool | None]:
    """What a view of k-mers or minimizers is made with; lengths that don't fit raise."""
    if not 0 < k <= 32 or m is not None and not 0 < m <= k:
        raise ValueError("k lies between 1 and 32, m between 1 and k")
    return {"k": k, "m": m, "canonical": canonical, "bits": 2 * k, "window": None if m is None else k - m + 1}


def _windows(df: DataFrame, rec: str, seq: str, k: int) -> DataFrame:
    d = df.select(F.col(rec).alias("rec"), clean(F.col(seq)).alias("s"))
    d = d.select("rec", F.encode("s", "UTF-8").alias("s"), F.encode(reverse_complement(F.col("s")), "UTF-8").alias("r"), F.length("s").alias("n")).where(F.col("n") >= k)
    return d.select("rec", "s", "r", "n", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("position"))


def _slice(raw: str, start: Column, k: int) -> Column:
    return F.substring(F.col(raw), start + 1, F.lit(k)).cast("string")


def kmers(df: DataFrame, k: int, rec: str = "rec", seq: str = "seq", canonical: bool = False, reference_tail: bool = False) -> DataFrame:
    """(rec, kmer, position) of every window without a break; position counts from 0.

    reference_tail leaves out a window that ends at the sequence's last base. Null
    sequences and those shorter than k give no row.
    """
    d = _windows(df, rec, seq, k)
    if reference_tail:
        d = d.where(F.col("position") + k < F.col("n"))
    kmer = _slice("s", F.col("position"), k)
    d = d.withColumn("kmer", kmer).where(F.instr("kmer", "N") == 0)
    if canonical:
        d = d.withColumn("kmer", F.least("kmer", _slice("r", F.col("n") - k - F.col("position"), k)))
    return d.select("rec", "kmer", F.col("position").cast("bigint").alias("position"))


def with_ids(found: DataFrame) -> DataFrame:
    """A dense number per record, in order of position."""
    return found.withColumn("id", (F.row_number().over(Window.partitionBy("rec").orderBy("position")) - 1).cast("bigint"))


def kmers_with_breaks(df: DataFrame, k: int, rec: str = "rec", seq: str = "seq", canonical: bool = False) -> DataFrame:
    """(rec, kmer, position, id): k-mers and, after a k-mer, one null row for each run of breaks; ids count both.

    A break row's position is that of the window whose last character breaks.
    """
    d = _windows(df, rec, seq, k).withColumn("kmer", _slice("s", F.col("position"), k))
    first_break = (F.instr("kmer", "N") == k) & (F.col("position") > 0) & (F.instr(_slice("s", F.col("position") - 1, k), "N") == 0)
    d = d.where((F.instr("kmer", "N") == 0) | first_break)
    whole = F.least("kmer", _slice("r", F.col("n") - k - F.col("position"), k)) if canonical else F.col("kmer")
    d = d.select("rec", F.when(F.instr("kmer", "N") == 0, whole).alias("kmer"), F.col("position").cast("bigint").alias("position"))
    return with_ids(d)


def break_offsets(df: DataFrame, rec: str = "rec", seq: str = "seq") -> DataFrame:
    """(rec, position, offset): bases since the last break, at each base."""
    before = Window.partitionBy("rec").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    d = df.select(F.col(rec).alias("rec"), F.posexplode(F.split(clean(F.col(seq)), "N")).alias("segment", "part"))
    d = d.withColumn("start", F.coalesce(F.sum(F.length("part") + 1).over(before), F.lit(0))).where("part <> ''")
    d = d.select("rec", "start", F.posexplode(F.sequence(F.lit(1), F.length("part"))).alias("i", "offset"))
    return d.select("rec", (F.col("start") + F.col("i")).cast("bigint").alias("position"), F.col("offset").cast("bigint").alias("offset"))


def spectrum(found: DataFrame, kmer: str = "kmer", count: str | None = None) -> DataFrame:
    """(multiplicity, kmers): how many distinct k-mers occur how often; rows count once, or by a column."""
    c = found.groupBy(kmer).agg((F.sum(count) if count else F.count("*")).alias("multiplicity"))
    return c.groupBy("multiplicity").agg(F.count("*").alias("kmers"))
