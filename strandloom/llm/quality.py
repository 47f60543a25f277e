"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts. The trees are grown in numpy on histograms of
a bounded sample of labelled rows, then flattened into node arrays that score a
batch for all trees at once. Chosen features are monotone: more of them never
raises a score. Fixed base rules hold beside the model's verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of the base rules, and the bound on labelled rows that the trees see.
SYMBOLS = b"#*$%&|<>"
SAMPLE = 20_000

SPACE = b" \t\n\r\x0b\x0c"
UPPER, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b"!?.,;:"
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "shouts", "distinct", "line_words", "bars", "ends")
#: -1: a higher value never raises the score.
MONOTONE = (0, 0, -1, -1, -1, -1, 0, -1, 0, 0, -1, 0)


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a three-word window found twice or more; distinct words."""
    ids: dict[bytes, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in words]
    n, v = len(seq), len(ids)
    if n < 4:
        return 0, v
    if v < 1 << 21:
        a = np.array(seq, np.int64)
        keys = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:  # exact for any number of distinct words: pairs first, then pairs with the third
        a = np.array(seq, np.int64)
        _, pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)
        keys = pair * v + a[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= again
    cover[1:-1] |= again
    cover[2:] |= again
    return int(cover.sum()), v


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))  # noqa: E731  how many of these bytes
    chars = len(text or "") - without(SPACE)
    symbols = without(SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat, distinct = repeated_words(words)
    w, c, k = max(n, 1), max(chars, 1), max(lines, 1)
    x = [np.log1p(n), chars / w, symbols / w, dup / k, repeat / w, without(UPPER) / c, without(DIGITS) / c, raw.count(b"!") / w, distinct / w, n / k, raw.count(b"|") / w, without(MARKS) / w]
    return (n, chars, symbols, dup, repeat), x


@dataclass
class Trees:
    """Flattened nodes: a leaf points at itself. Columns of ``roots`` start the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality per row of x."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, l2: float = 1.0) -> Trees:
    """Boosted trees for log loss. With one class only, every score is its share."""
    nodes: list[list[float]] = []
    roots: list[int] = []
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    f = np.full(len(y), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1) if len(y) else np.zeros(x.shape, int)

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + l2), lo, hi))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        value = leaf(g[rows].sum(), h[rows].sum(), lo, hi)
        nodes.append([0, 0.0, me, me, value * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            G, H = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b, size = binned[rows, j], len(c) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(G - gl) / (H - hl + l2), lo, hi)
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((G - gl) * vr + 0.5 * (H - hl + l2) * vr**2) + (G * value + 0.5 * (H + l2) * value**2)
                ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[j] * (vr - vl) >= 0)
                if ok.any() and (k := int(np.argmax(np.where(ok, gain, -np.inf)))) >= 0 and gain[k] > best[0]:
                    best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            mid = (vl + vr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[monotone[j]]
            goes = binned[rows, j] <= k
            left = grow(rows[goes], g, h, level + 1, *bounds[0])
            right = grow(rows[~goes], g, h, level + 1, *bounds[1])
            nodes[me] = [j, float(cuts[j][k]), left, right, 0.0]
        return me

    for _ in range(rounds if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-f))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = _flat(nodes, [first], depth, 0.0)
        at = np.full(len(y), first)
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), one.feature[at]] <= one.threshold[at], one.left[at], one.right[at])
        f = f + one.value[at]
    return _flat(nodes or [[0, 0.0, 0, 0, 0.0]], roots or [0], depth, base)


def _flat(nodes: list[list[float]], roots: list[int], depth: int, base: float) -> Trees:
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, base)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"y": b.iloc[:, 1], "x": [statistics(t)[1] for t in b.iloc[:, 0]]})


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from labelled documents: all of them, or about ``sample`` by a seeded hash of the id.

    A doc_id with several labels counts with their mean, rounded; one with several
    texts counts once, with the least; rows with a null id or label are left out. Sampled ids, at most a small multiple of
    ``sample`` numbers, are broadcast.
    """
    lab = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.round(F.avg(label)).alias("_y"))
    n = lab.count()
    if n > sample:
        lab = lab.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    got = d.join(F.broadcast(lab), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select("_t", F.col("_y").cast("double")).mapInPandas(_features, "y double, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, got["y"]])  # the same trees whatever order the rows come in
    return fit(x[order], got["y"].to_numpy(float)[order])


def assess(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept.

    Repeated rows fare alike, a score at the threshold is kept, texts of any length are
    read whole, an empty table gives no row, and columns may have any names.
    base_failed: fewer than 50 words, or over half of them in repeated three-word
    windows. kept: not base_failed and score >= threshold. Null text is empty.
    With ``carry``, the rows of docs that are kept, with their own columns.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    schema = docs.schema if carry else f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            base = np.array([g[0] for g in got], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            score = trees.score(np.array([g[1] for g in got], float).reshape(-1, len(FEATURES)))
            kept = ~failed & (score >= threshold)
            if carry:
                yield b.filter(pa.array(kept))
            else:
                arrays = [b.column(b.schema.get_field_index(doc_id)), *map(pa.array, base.T.copy()), pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return (docs if carry else docs.select(doc_id, text)).mapInArrow(run, schema)
