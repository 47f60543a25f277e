"""The corpus pipeline: filter, de-duplicate lines and documents, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import linededup, mixing, packing, quality, simhash
from strandloom.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees' verdict, as they were.

    Null and blank texts fail; repeated rows fare alike; ties at the threshold stay; no rows give none.
    """
    trees = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, trees, carry=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that the corpus has elsewhere, exactly or nearly.

    Of a component the first line stays, by doc_id (nulls last) and line number; repeated rows are cut
    alike; null and blank texts stay; a text that loses all lines with words leaves; no rows give none.
    """
    return linededup.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id, nulls last.

    Texts without words, null ones too, are one group; repeated rows are reduced to one; no rows give none.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them.

    Texts without words leave; a null source is a source; repeated rows have parts of their own; no rows give none.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null text is its end token alone; repeated rows are packed each on its own; no rows give none.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trees, MinHash components and token ids have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
