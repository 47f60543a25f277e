"""FASTA and FASTQ, plain or gzipped, through Spark's text source."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq, qual) rows. Sequences may span lines; qual is null.

    Records are split at a > that begins a line, by the source itself, so a large
    plain file is read in parallel; a gzipped file is one task.
    """
    raw = spark.read.text(path, lineSep="\n>")
    r = raw.select(F.regexp_replace("value", r"^>", "").alias("v")).where(F.trim("v") != "")
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    comment = F.nullif(F.regexp_extract(head, r"^\S*\s+(.*)$", 1), F.lit(""))
    return r.select(name.alias("name"), comment.alias("comment"), body.alias("seq"), F.lit(None).cast("string").alias("qual"))


def fastq_records(lines: Iterable[str]) -> Iterator[tuple[str, str | None, str, str]]:
    """(name, comment, seq, qual) of records whose sequences and qualities may span lines.

    A quality ends where it is as long as its sequence, so its lines may begin with
    any character. A record without as many qualities as bases raises.
    """
    it = (line.rstrip("\r") for line in lines)
    for head in it:
        if not head.strip():
            continue
        if not head.startswith("@"):
            raise ValueError("FASTQ: a record is malformed: it doesn't begin with @")
        seq, qual = [], []
        for line in it:
            if line.startswith("+"):
                break
            seq.append(line.strip())
        bases, have = "".join(seq), 0
        while have < len(bases):
            line = next(it, None)
            if line is None:
                raise ValueError("FASTQ: a record is malformed: its quality is too short")
            qual.append(line)
            have += len(line)
        if have > len(bases):
            raise ValueError("FASTQ: a record is malformed: its quality is too long")
        name, *comment = head[1:].split(None, 1) if head[1:2].strip() else ["", head[1:]]
        yield name, ("".join(comment).strip() or None), bases, "".join(qual)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq, qual) rows; malformed records raise.

    Where a record begins shows only from the records before, so a file is one task;
    many files are read in parallel. Keep files to 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "comment", "seq", "qual"]
        for b in batches:
            for text in b.column(0).to_pylist():
                records = fastq_records((text or "").split("\n"))
                while part := list(islice(records, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part)], names)

    return spark.read.text(path, wholetext=True).mapInArrow(run, "name string, comment string, seq string, qual string")


def write_fastq(df: DataFrame, path: str, width: int = 60) -> None:
    """Write (name, comment, seq, qual) rows with lines of ``width`` characters."""
    head = F.concat(F.lit("@"), F.col("name"), F.coalesce(F.concat(F.lit(" "), F.col("comment")), F.lit("")))
    body = lambda c: F.rtrim(F.regexp_replace(c, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    df.select(F.concat(head, F.lit("\n"), body("seq"), F.lit("\n+\n"), body("qual")).alias("value")).write.text(path)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """Write (name, comment, seq) rows with lines of ``width`` bases."""
    head = F.concat(F.lit(">"), F.col("name"), F.coalesce(F.concat(F.lit(" "), F.col("comment")), F.lit("")))
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    df.select(F.concat(head, F.lit("\n"), body).alias("value")).write.text(path)
