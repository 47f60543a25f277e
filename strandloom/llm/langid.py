"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled
windows. Texts are cut into windows of ``WINDOW`` bytes; both directions start at
a window's ends, every byte position gets class probabilities from the two
states, and a document's probabilities are the mean over all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import remainder

WINDOW, HIDDEN = 64, 12
#: Bounds on what training sees: documents of a language, windows of a document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 256, 8
UNKNOWN = "und"


@dataclass
class Network:
    """wx: (2, 256, 3H) input rows by byte; u: (2, H, 3H); b: (2, 3H); wo: (2, H, C); bo: (C,). Gates are update, reset, candidate."""

    wx: np.ndarray
    u: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    classes: list[str]

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.u, self.b, self.wo, self.bo]


def new_network(classes: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    r = np.random.default_rng(seed)
    c, h = len(classes), hidden
    init = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    return Network(init(2, 256, 3 * h), init(2, h, 3 * h), np.zeros((2, 3 * h), np.float32), init(2, h, c), np.zeros(c, np.float32), classes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of windows x (B, T) with labels y, and its gradients."""
    bsz, steps = x.shape
    h = net.u.shape[1]
    states, saved = np.zeros((2, steps, bsz, h), np.float32), []
    for d in (0, 1):
        s, keep = np.zeros((bsz, h), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a, g = net.wx[d][x[:, t]] + net.b[d], s @ net.u[d]
            z, r = _sigmoid(a[:, :h] + g[:, :h]), _sigmoid(a[:, h : 2 * h] + g[:, h : 2 * h])
            n = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
            keep.append((t, s, z, r, n, g[:, 2 * h :]))
            s = n + z * (s - n)
            states[d, t] = s
        saved.append(keep)
    logits = states[0] @ net.wo[0] + states[1] @ net.wo[1] + net.bo
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    at = (np.arange(steps)[:, None], np.arange(bsz)[None, :], y[None, :])
    loss = float(-np.log(p[at] + 1e-9).mean())
    dl = p
    dl[at] -= 1
    dl /= steps * bsz
    flat = dl.reshape(-1, dl.shape[2])
    gwx, gu, gb = np.zeros_like(net.wx), np.zeros_like(net.u), np.zeros_like(net.b)
    gwo = np.stack([states[d].reshape(-1, h).T @ flat for d in (0, 1)])
    for d in (0, 1):
        carry = np.zeros((bsz, h), np.float32)
        back, das = dl @ net.wo[d].T, np.zeros((steps, bsz, 3 * h), np.float32)
        for t, s, z, r, n, gn in reversed(saved[d]):
            ds = back[t] + carry
            dn, dz = ds * (1 - z) * (1 - n * n), ds * (s - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            das[t] = da
            gu[d] += s.T @ dg
            carry = ds * z + dg @ net.u[d].T
        one = np.zeros((steps * bsz, 256), np.float32)
        one[np.arange(steps * bsz), x.T.reshape(-1)] = 1
        rows = das.reshape(-1, 3 * h)
        gwx[d], gb[d] = one.T @ rows, rows.sum(axis=0)
    return loss, [gwx, gu, gb, gwo, flat.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, classes: list[str], steps: int = 160, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on balanced batches of windows; deterministic for the same rows in the same order."""
    net, r = new_network(classes, seed=seed), np.random.default_rng(seed)
    rows = [np.flatnonzero(y == c) for c in range(len(classes))]
    m, v = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    for k in range(1, steps + 1 if len(classes) > 1 else 1):
        pick = np.concatenate([r.choice(a, -(-batch // len(classes))) for a in rows])
        _, grads = gradients(net, x[pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        step = rate * min(1.0, 4 * (1 - k / (steps + 1)))
        for p, g, mi, vi in zip(net.params(), grads, m, v):
            g = g * min(1.0, 1 / (norm + 1e-6))
            mi += 0.1 * (g - mi)
            vi += 0.01 * (g * g - vi)
            p -= (step * (mi / (1 - 0.9**k)) / (np.sqrt(vi / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Position probabilities of many windows at once, the gates' tables kept apart so that each step works on whole arrays."""

    def __init__(self, net: Network):
        h = self.h = net.u.shape[1]
        c = np.ascontiguousarray
        wx = net.wx + net.b[:, None, :]
        # Halved: a sigmoid is a tanh of half its argument.
        self.gates = [(c(wx[d][:, : 2 * h]) / 2, c(wx[d][:, 2 * h :]), c(net.u[d][:, : 2 * h]) / 2, c(net.u[d][:, 2 * h :])) for d in (0, 1)]
        self.net = net

    def windows(self, x: np.ndarray) -> np.ndarray:
        """(T, B, C) probabilities of windows x (T, B)."""
        steps, bsz = x.shape
        h, total = self.h, None
        for d in (0, 1):
            tzr, tn, uzr, un = self.gates[d]
            states, s = np.empty((steps, bsz, h), np.float32), np.zeros((bsz, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                zr = s @ uzr
                zr += tzr[x[t]]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                n = s @ un
                n *= zr[:, h:]
                n += tn[x[t]]
                np.tanh(n, out=n)
                s = s - n
                s *= zr[:, :h]
                s += n
                states[t] = s
            part = states.reshape(-1, h) @ self.net.wo[d]
            total = part if total is None else total + part
        total += self.net.bo
        total -= total.max(axis=1, keepdims=True)
        np.exp(total, out=total)
        total /= total.sum(axis=1, keepdims=True)
        return total.reshape(steps, bsz, -1)

    def documents(self, texts: list[bytes], batch: int = 2048) -> np.ndarray:
        """Mean probabilities (documents, C); no text may be empty.

        A text's last window ends at its end and adds only the positions that no
        window before it had; shorter texts are padded with spaces that don't count.
        """
        out = np.zeros((len(texts), len(self.net.classes)))
        held: list[np.ndarray] = []
        owner: list[tuple[int, int, int]] = []  # document, first and last position that count

        def run() -> None:
            p = self.windows(np.ascontiguousarray(np.stack(held).T))
            o = np.array(owner)
            t = np.arange(WINDOW)[:, None]
            p *= ((t >= o[:, 1]) & (t < o[:, 2]))[:, :, None]
            np.add.at(out, o[:, 0], p.sum(axis=0, dtype=np.float64))
            held.clear()
            owner.clear()

        for i, raw in enumerate(texts):
            a = np.frombuffer(raw.ljust(WINDOW), np.uint8)
            n = len(raw)
            for at in range(0, n, WINDOW):
                start = max(0, min(at, n - WINDOW))
                held.append(a[start : start + WINDOW])
                owner.append((i, at - start, min(n, start + WINDOW) - start))
                if len(held) == batch:
                    run()
        if held:
            run()
        return out / np.array([[len(t)] for t in texts])


def training_windows(docs: DataFrame, doc_id: str, text: str, lang: str, per_lang: int, per_doc: int) -> DataFrame:
    """(lang, window): up to about per_lang documents of each language, by a seeded hash of the id and text.

    Rows that repeat an id and text count once.
    """
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_l"))
    d = d.where(F.col("_l").isNotNull() & F.col("_t").rlike(r"\p{L}"))
    share = d.groupBy("_l").count().select(F.col("_l").alias("_k"), (F.lit(per_lang) / F.col("count")).alias("_s"))
    d = d.join(F.broadcast(share), F.col("_l") == F.col("_k"))  # a row per language
    d = d.where(F.pmod(F.xxhash64("_id", "_t", F.lit(77)), F.lit(1 << 30)) < F.col("_s") * (1 << 30))
    d = d.groupBy("_l", "_id", F.xxhash64("_t").alias("_h")).agg(F.min("_t").alias("_t"))
    d = d.select("_l", "_id", F.encode("_t", "UTF-8").alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))).alias("_j"))
    at = F.pmod(F.xxhash64("_id", "_j"), F.greatest(F.octet_length("_r") - (WINDOW - 1), F.lit(1))) + 1
    return d.select(F.col("_l").alias("lang"), F.substring("_r", at.cast("int"), F.lit(WINDOW)).alias("window"))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = DOCS_PER_LANG, per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """A network for the languages of docs; None where no labelled text has a letter."""
    rows = sorted((r[0], bytes(r[1])) for r in training_windows(docs, doc_id, text, lang, per_lang, per_doc).collect())
    classes = sorted({r[0] for r in rows})
    if not classes:
        return None
    x = np.stack([np.frombuffer(w.ljust(WINDOW), np.uint8) for _, w in rows])
    return train(x, np.array([classes.index(c) for c, _ in rows]), classes)


def identify(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row. Null texts and texts without a letter are ``und`` with score 0.

    Whole texts of any length are read, in windows; equal texts fare alike, so repeated
    rows do; of equal probabilities the first language by code point wins; an empty table
    gives no row; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"))
    if net is None:
        return d.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            texts = [t.encode() if t else b"" for t in b.column(1).to_pylist()]
            have = [i for i, t in enumerate(texts) if t]
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if have:
                p = scorer.documents([texts[i] for i in have])
                for i, k, s in zip(have, p.argmax(axis=1), p.max(axis=1)):
                    names[i], score[i] = net.classes[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """Documents that training leaves out: crc32 of the id modulo 3 is 1."""
    return remainder(F.col(doc_id), 3) == 1
