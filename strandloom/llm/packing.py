"""Order-preserving packing by dynamic programming.

Each partition's documents form one token stream in their order. Windows of at
most ``length`` tokens are cut at document ends, sentence ends or, where a
sentence is long, every ``GAP`` tokens. The cost of a window is its padding plus
a penalty for what its end cuts. Padding is linear in the window's start, so the
best start for an end is a sliding-window minimum, kept in a monotone queue:
linear time in the number of cut positions. Blocks of the stream are settled one
after another, so memory is bounded by a block and the longest document. A partition's last
windows are cut by the same costs; its end is a document's end, so nothing is cut there,
and what the last window lacks is padding: less than ``length`` tokens a partition.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
SENTENCE_CUT, HARD_CUT, GAP = 1.0, 8.0, 64


class Encoder:
    """Token ids of a byte-level BPE vocabulary.

    Ids equal those of ``tokenizers`` with the JSON file of the vocabulary
    (add_special_tokens=False). With ``json_path`` that library is used; else the
    same vocabulary as ranks, which another library encodes several times faster.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        if json_path and not ranks_path:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(json_path)
            self.ids = lambda s: t.encode(s, add_special_tokens=False).ids
            self.size = t.get_vocab_size()
            decode = lambda i: t.decode([i], skip_special_tokens=False).encode()
        else:
            import base64

            import public_tokenizers as public
            import tiktoken

            with open(ranks_path or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = "<|endoftext|>"
            t = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
            self.ids = lambda s: t.encode(s, allowed_special="all") if special in s else t.encode_ordinary(s)
            self.size = len(ranks) + 1
            decode = t.decode_single_token_bytes
        self.ends = np.array([(b := decode(i)).rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in b for i in range(self.size)])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), np.uint32)


def cut_positions(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the stream at which a window may end, ascending, and their penalties."""
    soft = np.flatnonzero(ends[ids]) + 1
    pos = np.union1d(soft, doc_ends)
    edges = np.concatenate([[0], pos, [len(ids)]])
    wide = np.flatnonzero(np.diff(edges) > gap)
    hard = [np.arange(edges[i] + gap, edges[i + 1], gap) for i in wide]
    pos, fresh = np.union1d(pos, np.concatenate(hard) if hard else pos), len(hard)
    cost = np.full(len(pos), SENTENCE_CUT)
    if fresh:
        cost[np.isin(pos, np.concatenate(hard))] = HARD_CUT
    cost[np.isin(pos, doc_ends)] = 0
    return pos[pos > 0], cost[pos > 0]


def plan_cuts(pos: np.ndarray, cost: np.ndarray, length: int) -> tuple[list[int], list[float]]:
    """For each position, the index of the best window start (-1: the stream's start) and its total cost.

    Least sum over windows of padding plus penalty. A window of ``length`` / 2 or
    ``length`` / 4 tokens, powers of two, needs no padding. Positions may lie at
    most ``length`` apart.
    """
    at, pen = pos.tolist(), cost.tolist()
    index = {p: i for i, p in enumerate(at)} | {0: -1}
    best, back = [0.0] * len(at), [0] * len(at)
    queue = deque([(0.0, 0, -1)])  # (cost + position, position, index), costs ascending
    half, quarter = length // 2, length // 4
    get, pop, push = index.get, queue.pop, queue.append
    for j, p in enumerate(at):
        while queue[0][1] < p - length:
            queue.popleft()
        v, _, i = queue[0]
        v += length - p
        for short in (half, quarter):
            k = get(p - short)
            if k is not None and (w := best[k] if k >= 0 else 0.0) < v:
                v, i = w, k
        v += pen[j]
        best[j], back[j] = v, i
        key = v + p
        while queue and queue[-1][0] >= key:
            pop()
        push((key, p, j))
    return back, best


def windows(pos: np.ndarray, cost: np.ndarray, length: int, last: bool) -> np.ndarray:
    """Ends of the windows that are settled. Without ``last``, up to ``length`` tokens stay open."""
    if not len(pos):
        return pos
    back, best = plan_cuts(pos, cost, length)
    if last:
        j = len(pos) - 1
    else:
        open_from = int(np.searchsorted(pos, pos[-1] - length, side="right"))
        j = open_from + int(np.argmin(best[open_from:]))
    out = []
    while j >= 0:
        out.append(pos[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


class Packer:
    """Packs documents of one stream; ``add`` and ``finish`` return settled pieces."""

    def __init__(self, encoder: Encoder, length: int = 2048, block: int = 1 << 18, first_sequence: int = 0):
        self.encoder, self.length, self.block, self.sequence = encoder, length, block, first_sequence
        self.docs: list[tuple[object, np.ndarray, int]] = []  # (id, ids, ids packed before)
        self.held = 0

    def add(self, doc: object, text: str | None) -> list[tuple]:
        ids = np.append(self.encoder.encode(text or ""), np.uint32(END_ID)).astype("<u4")
        self.docs.append((doc, ids, 0))
        self.held += len(ids)
        return self.settle(False) if self.held >= self.block else []

    def finish(self) -> list[tuple]:
        return self.settle(True) if self.docs else []

    def settle(self, last: bool) -> list[tuple]:
        ids = np.concatenate([d[1][d[2] :] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        pos, cost = cut_positions(ids, doc_ends, self.encoder.ends, min(GAP, self.length))
        cuts = windows(pos, cost, self.length, last)
        end = int(cuts[-1])
        marks = np.union1d(np.concatenate([[0], cuts]), doc_ends[doc_ends < end])
        doc = np.searchsorted(doc_ends, marks[:-1], side="right")
        seq = np.searchsorted(cuts, marks[:-1], side="right")
        doc_starts, seq_starts = np.concatenate([[0], doc_ends]), np.concatenate([[0], cuts])
        raw, out = memoryview(ids.astype("<u4").tobytes()), []
        for a, b, d, s in zip(marks[:-1].tolist(), marks[1:].tolist(), doc.tolist(), seq.tolist()):
            name, all_ids, before = self.docs[d]
            out.append((name, a - int(doc_starts[d]) + before, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(all_ids), self.sequence + s, a - int(seq_starts[s])))
        self.sequence += len(cuts)
        kept = int(np.searchsorted(doc_ends, end, side="right"))
        rest = self.docs[kept:]
        if rest and (done := end - int(doc_starts[kept])) > 0:
            rest[0] = (rest[0][0], rest[0][1], rest[0][2] + done)
        self.docs, self.held = rest, len(ids) - end
        return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 2048, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of its text, then END_ID; null text is empty. Each
    id is in exactly one piece. Documents stay in the order of their partition,
    which is never shuffled; sequence ids start anew, apart, in each partition.
    Rows that repeat a doc_id are packed each on its own; equal texts give equal ids;
    texts of any length are taken whole; other columns are ignored; no rows give none.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(Encoder(json_path, ranks_path), length, first_sequence=TaskContext.get().partitionId() << 40)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            out = [p for d, t in zip(b.iloc[:, 0], b.iloc[:, 1]) for p in packer.add(d, t)]
            if out:
                yield pd.DataFrame(out, columns=names)
        if out := packer.finish():
            yield pd.DataFrame(out, columns=names)

    d = docs.select(F.col(doc_id).cast("string"), F.col(text))  # ids as text: pandas would turn nullable integers into floats
    out = d.mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
