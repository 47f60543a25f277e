"""Shared helpers of the training-data operators.

``workspace`` gives a fresh folder below ``spark.checkpoint.dir``: the one place
that the driver and all executors can read, so a table written there survives
the loss of any executor. ``materialize`` cuts lineage by writing such a table.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every contract here: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def workspace(spark: SparkSession, what: str) -> str:
    """A new path (not yet made) below the shared folder."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; options: further ones of the writer."""
    spark = df.sparkSession
    path = workspace(spark, what)
    df.write.options(compression=compression, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandloom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_strandloom_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, a variant that no column of df has (input columns may clash)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; -1 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(-1)).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
