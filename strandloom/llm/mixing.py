"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source is a stream of words: its documents in a seeded order. The stream is
cut into blocks of equally many words, and runs of blocks form shards. Highest
quotients first give each source a whole number of blocks, then each shard of a
source its share of them. A shard takes its quota as a seeded circular run of its
blocks; a quota of more than all blocks takes the source whole, up to three times,
before that. What a document gives follows in closed form from its place in the
stream, so blocks are never rows.

Driver state is one row per source (name, words, documents) and at most
``shards`` integers for each: linear in the number of sources only.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import fresh, materialize, word_count

#: A plan of at most this many numbers is broadcast; a larger one is joined by shuffling.
BROADCAST_NUMBERS = 1_000_000


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Whole seats by highest quotients w / (2 q + 1); ties go to the earlier entry."""
    w = np.asarray(weights, float)
    if seats <= 0 or not (w > 0).any():
        return np.zeros(len(w), np.int64)
    given = lambda d: np.floor(w / d + 0.5)  # noqa: E731  seats at divisor d
    lo, hi = w.sum() / (seats + len(w) + 1), 2 * w.max() + 1
    for _ in range(200):  # the least divisor that doesn't give too many
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if given(mid).sum() <= seats else (mid, hi)
    q = given(hi).astype(np.int64)
    heap = [(-w[i] / (2 * q[i] + 1), i) for i in range(len(w)) if w[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(q.sum())):
        _, i = heapq.heappop(heap)
        q[i] += 1
        heapq.heappush(heap, (-w[i] / (2 * q[i] + 1), i))
    return q


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = 1.0, most: float = 3.0) -> np.ndarray:
    """Words per source: ``share`` of all words by weight, none above ``most`` times its size.

    What a capped source can't take is shared among the others by weight until
    none is above its cap. If all are capped, the total falls short.
    """
    cap, out = most * sizes, np.zeros(len(sizes))
    free, left = cap > 0, share * float(sizes.sum())
    while free.any():
        want = left * weights / weights[free].sum()
        over = free & (want >= cap)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = cap[over]
        left -= float(cap[over].sum())
        free &= ~over
    return out


def plan(stats: list[tuple[str | None, int, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, block: int | None = None, shards: int = 256, seed: int = 7) -> tuple[list[tuple], int]:
    """A row of the plan table for each (source, words, documents), and the words of a block.

    Sources take the weights in turn by code point, null last. Without ``block``,
    a block is 1/2048 of the least positive target, from 1 to 512 words, so that
    rounding to whole blocks stays below 0.1 % of any target.
    """
    stats = sorted(stats, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = np.array([x[1] for x in stats], np.int64)
    want = targets(sizes, np.array([weights[i % len(weights)] for i in range(len(stats))], float), share, most)
    block = block or int(min(512, max(1, want[want > 0].min() // 2048))) if (want > 0).any() else 1
    quotas = sainte_lague(want, round(want.sum() / block))
    rows = []
    for i, ((name, size, docs), q) in enumerate(zip(stats, quotas)):
        n = -(-size // block)
        q = min(int(q), most * n)
        whole, rest = divmod(q, n) if n else (0, 0)
        run = max(1, -(-n // max(1, min(shards, docs // 64))))  # blocks of a shard: of 64 documents or more
        lengths = np.minimum(run, n - run * np.arange(-(-n // run)))
        quota = sainte_lague(lengths, rest)
        rng = np.random.default_rng([seed, i])
        offset = (rng.random(len(lengths)) * lengths).astype(np.int64)
        ends = lambda x: [int(v) for v in x] + [0]  # noqa: E731  one past the last shard
        rows.append((i, name, int(size), float(want[i]), int(whole), run, ends(lengths), ends(quota), ends(offset), [0, *np.cumsum(quota).tolist()]))
    return rows, block


def _chosen_before(p: Column, block: int) -> Column:
    """Words that the chosen blocks hold before position p of the source's stream."""
    j = F.floor(p / block)
    shard = F.floor(j / F.col("run"))
    jj = j - shard * F.col("run")
    n, r, off, before = (F.get(c, shard.cast("int")) for c in ("lengths", "quota", "offset", "before"))
    wrap = F.greatest(off + r - n, F.lit(0))
    blocks = F.greatest(F.least(jj, off + r, n) - off, F.lit(0)) + F.least(jj, wrap)
    inside = ((jj >= off) & (jj < off + r)) | (jj < wrap)
    return (before + blocks) * block + F.when(inside, p - j * block).otherwise(0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, block: int | None = None, shards: int = 256, seed: int = 7) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, taken) per row of docs.

    taken: words that the mix takes of the document, repeats counted, at most
    ``most`` times its size. The same rows and seed give the same result in any
    partitioning; rows that repeat doc_id and size may exchange their parts. Null
    text has no words, a null source is a source of its own; a null doc_id is
    ordered like any other value.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("text_hash"), word_count(F.col(text)).alias("size"))
    d = materialize(d, "mix-sizes")
    stats = [(r[0], r[1], r[2]) for r in d.groupBy("source").agg(F.sum("size"), F.count("*")).toLocalIterator()]
    rows, block = plan(stats, weights, share, most, block, shards, seed)
    kinds = "sid int, source string, source_size long, target double, whole int, run long, lengths array<long>, quota array<long>, offset array<long>, before array<long>"
    table = spark.createDataFrame(rows, kinds)
    small = sum(len(r[7]) for r in rows) * 4 <= BROADCAST_NUMBERS
    names = table.select("sid", F.col("source").alias("name"))
    names = F.broadcast(names) if small else names
    d = d.join(names, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "text_hash", "size", "sid")
    # The stream's order: a seeded hash. Its top bits make cells, each a small window.
    d = d.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("cell", F.shiftright("h", 64 - int(math.log2(4096))).cast("int"))
    cells = d.groupBy("sid", "cell").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("start", F.sum("words").over(Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    cells = cells.select("sid", "cell", F.coalesce("start", F.lit(0)).alias("start"))
    upto = Window.partitionBy("sid", "cell").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(cells, ["sid", "cell"]).withColumn("end", F.col("start") + F.sum("size").over(upto))
    d = d.join(F.broadcast(table) if small else table, "sid")
    taken = F.col("whole") * F.col("size") + _chosen_before(F.col("end"), block) - _chosen_before(F.col("end") - F.col("size"), block)
    return d.select("doc_id", "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _cut(kinds: list[str], text: str, taken: str, size: str):
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def repeat(batches):
        for b in batches:
            out, texts = [], []
            for i, (t, n, s) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (text, taken, size)))):
                out += [i] * (n // s)
                texts += [t] * (n // s)
                if n % s:
                    raw = t.encode()
                    for k, m in enumerate(word.finditer(raw), 1):
                        if k == n % s:
                            break
                    out.append(i)
                    texts.append(raw[: m.end()].decode())
            rows = b.select(kinds).take(pa.array(out, pa.int64()))
            yield rows.set_column(kinds.index(text), rows.schema.field(text), pa.array(texts, rows.schema.field(text).type))

    return repeat


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of docs as the mix takes them: whole as often as they fit into
    ``taken``, then once more up to the words that are left. Documents without
    words leave, so null and blank texts do. A column n_chars follows the text; other
    columns, whatever their names, are repeated. Rows that repeat doc_id and text each
    have a part of their own; no rows give none.
    """
    doc, h, mine, row, place, taken, size = fresh(docs, "mix_doc", "mix_hash", "mix_own_hash", "mix_row", "mix_own_row", "mix_taken", "mix_size")
    m = mix(docs, doc_id, text, source, **how)
    m = m.withColumn(row, F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("taken")))
    m = m.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(h), row, F.col("taken").alias(taken), F.col("size").alias(size)).where(F.col(taken) > 0)
    d = docs.withColumn(mine, F.xxhash64(text))
    d = d.withColumn(place, F.row_number().over(Window.partitionBy(doc_id, mine).orderBy(text)))
    j = d.join(m, F.col(doc_id).eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(h)) & (F.col(place) == F.col(row)))
    j = j.select(*docs.columns, taken, size)
    out = j.mapInArrow(_cut(docs.columns, text, taken, size), docs.schema)
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
