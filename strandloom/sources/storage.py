"""Saving and loading tables of nested values, and the bytes that a plain serialisation takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}


def save(df: DataFrame, path: str) -> None:
    """Write any nesting of atomic values, arrays and structs."""
    df.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def byte_size(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: fixed widths, 8 for each length of a string or array, structs by field; null has none."""
    name = kind.simpleString()
    if name in WIDTHS:
        size = F.lit(WIDTHS[name])
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        size = 8 + F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        if kind.elementType.simpleString() in WIDTHS:
            size = 8 + F.size(value) * WIDTHS[kind.elementType.simpleString()]
        else:
            size = 8 + F.aggregate(value, F.lit(0).cast("bigint"), lambda acc, e: acc + byte_size(e, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = F.lit(0)
        for f in kind.fields:
            size = size + byte_size(value[f.name], f.dataType)
    else:
        raise TypeError(f"no plain form for {name}")
    return F.coalesce(F.when(value.isNotNull(), size), F.lit(0)).cast("bigint")


def table_bytes(df: DataFrame) -> DataFrame:
    """(rows, bytes) of a table."""
    size = sum((byte_size(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the cluster's shared checkpoint folder; a local one only where none is set in local mode."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
