"""The thin queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import documents


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.langid import held_out, identify, learn

    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs.where(~held_out(docs))))
    return found.select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.quality import assess, learn

    docs = documents(spark, sf_dir)
    return assess(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.linededup import line_duplicates

    return line_duplicates(documents(spark, sf_dir)).drop("text_hash")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.simhash import near_duplicates

    near = near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.packing import pack

    return pack(documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.media import text_media

    return text_media(documents(spark, sf_dir))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.lm import score

    return score(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from strandloom.llm import licenses, warc

    return {"op1_warc": warc.oracle(), "op7_license": licenses.oracle()}
