"""SimHash near-duplicates: fingerprints, deletion-variant index, components.

Fingerprints of 64 bits are linked if at most two bits differ. They are cut into
two segments of 32 bits, so one segment of a linked pair differs by at most one
bit. The index holds, for each *distinct* fingerprint, both exact segments and
all one-wildcard variants of each; entries that share a variant are compared in
full. Copies never meet in it: equal texts are one fingerprint.

A variant with more than ``bucket`` fingerprints isn't compared pair by pair.
Its members go through the exact second way: each is listed under itself and its
64 one-bit neighbours; two fingerprints within two bits meet under some value,
all that meet under a value are within two bits of each other, and a value has
65 members at most. So one star per value links them without a pair join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import discard, fresh, materialize
from strandloom.llm.components import connected_components


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned number; no word: zero."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        h = np.array([digest(joined[i:j], 42) for i, j in zip(starts[at:to], stops[at:to])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row, fp as a signed long. Null text counts as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id), F.col(text), F.xxhash64(text))
    return d.mapInArrow(_fingerprints, f"doc_id {kind}, text_hash long, fp long")


def _compare(bucket: int, bits: int):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a run is a variant's fingerprints."""
        hot_key, kept_k, kept_f = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def work(k: np.ndarray, f: np.ndarray) -> pd.DataFrame | None:
            edge = np.flatnonzero(np.diff(k)) + 1
            size = np.diff(np.concatenate([[0], edge, [len(k)]]))
            big = np.repeat(size > bucket, size)
            a, b = [f[big]], [f[big]]
            k, f = k[~big], f[~big]
            for s in range(1, bucket):
                same = np.flatnonzero(k[:-s] == k[s:])
                if not len(same):
                    break
                x, idx = (f[same] ^ f[same + s]).view(np.uint64), (k[same] >> 32).astype(np.uint64)
                # Equal segments meet under the exact key; a wildcard counts only where it is used.
                ok = (idx >= 64) | ((x >> np.minimum(idx, np.uint64(63))) & np.uint64(1) == 1)
                ok &= np.bitwise_count(x) <= bits
                a.append(f[same[ok]])
                b.append(f[same[ok] + s])
            a, b = np.concatenate(a), np.concatenate(b)
            return pd.DataFrame({"a": a, "b": b}) if len(a) else None

        for d in batches:
            k, f = d["key"].to_numpy(), d["fp"].to_numpy()
            if hot_key is not None:  # the rest of a run that is being passed on
                cut = int(np.searchsorted(k, hot_key, side="right"))
                if cut:
                    yield pd.DataFrame({"a": f[:cut], "b": f[:cut]})
                    k, f = k[cut:], f[cut:]
                if not len(k):
                    continue
                hot_key = None
            k, f = np.concatenate([kept_k, k]), np.concatenate([kept_f, f])
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if last and (out := work(k[:last], f[:last])) is not None:
                yield out
            kept_k, kept_f = k[last:], f[last:]
            if len(kept_k) > bucket:
                hot_key = kept_k[0]
                yield pd.DataFrame({"a": kept_f, "b": kept_f})
                kept_k, kept_f = kept_k[:0], kept_f[:0]
        if len(kept_k) and (out := work(kept_k, kept_f)) is not None:
            yield out

    return pairs


def fingerprint_links(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """(a, b): links whose components are those of all pairs within two bits.

    fps: one column ``fp`` of distinct longs.
    """
    i, bit = F.col("i"), F.expr("shiftleft(1L, i)")
    segment = F.when((i < 32) | (i == 64), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wild = F.when(i < 64, segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i % 32)")))).otherwise(segment)
    index = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i"))
    index = index.select(F.shiftleft(i.cast("long"), 32).bitwiseOR(wild).alias("key"), "fp")
    index = index.repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(index.mapInPandas(_compare(bucket, 2), "a long, b long"), "simhash-links")
    hot = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    near = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    near = near.select("fp", F.when(i < 64, F.col("fp").bitwiseXOR(bit)).otherwise(F.col("fp")).alias("v"))
    near = near.groupBy("v").agg(F.collect_set("fp").alias("m")).where("size(m) > 1")  # 65 at most
    stars = near.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return found.where("a <> b").union(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id) per row of docs.

    component_id is the least doc_id reachable over links of at most two bits.
    Null text is empty, texts without words share fingerprint zero, repeated
    rows appear as often as they do in docs; a null doc_id takes part but is
    never a component's id unless all are null. Other columns are ignored.
    """
    fp = materialize(fingerprints(docs, doc_id, text), "simhash-fp")
    distinct = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = connected_components(fingerprint_links(distinct.select("fp")))
    joined = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    comp = materialize(joined.select("fp", "label").join(least, "label").select("fp", "component_id"), "simhash-components")
    discard(distinct, labels)
    return fp.join(comp, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the least (doc_id, text hash), null ids last.

    Rows that repeat both are reduced to one. All columns of docs come back.
    """
    near = near_duplicates(docs, doc_id, text)
    first = near.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("f"))
    x, h, n = fresh(docs, "kept_id", "kept_hash", "kept_row")
    first = first.select(F.col("f.doc_id").alias(x), F.col("f.text_hash").alias(h)).distinct()
    d = docs.withColumn(n, F.xxhash64(text))
    kept = d.join(first, F.col(doc_id).eqNullSafe(F.col(x)) & (F.col(n) == F.col(h)), "left_semi")
    once = Window.partitionBy(doc_id, n).orderBy(text)
    return kept.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).drop(n)
