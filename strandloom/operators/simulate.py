"""Random sequences and mutations from hashes of (seed, record, position): the same in any partitioning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.hashing import MASK64, double_hash64_np, remix_np


def _key(df: DataFrame, rec: str) -> tuple[str, Column]:
    """The type of a record's name and a number for it: itself if it is a whole one."""
    kind = df.schema[rec].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return kind, F.coalesce(F.col(rec).cast("bigint"), F.lit(-1)) if whole else F.xxhash64(rec)


#: Bases that are drawn at once, where records are shorter.
BLOCK = 1 << 16


def _groups(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """Stretches of records with about BLOCK bases each, or one record."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > BLOCK:
            yield at, i
            at, held = i, 0
        held += n or 0
    if at < len(sizes):
        yield at, len(sizes)


def _strings(parts: list[np.ndarray], size: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Strings of ASCII bytes, one after another."""
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    out = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))
    if null is not None and null.any():
        out = pc.if_else(pa.array(~null), out, None)
    return out.cast(pa.string())


def random_dna(df: DataFrame, length: int | Column, seed: int = 42, rec: str = "rec") -> DataFrame:
    """(rec, seq): a uniform sequence for each record, base i from the hash of (record, i).

    Whole-number records are their own key, others take a hash. A null length gives a
    null sequence, one of 0 or less an empty one. Many records are drawn at once.
    """
    kind, key = _key(df, rec)
    n = F.lit(length) if isinstance(length, int) else length
    letters = np.frombuffer(b"ACGT", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) << np.uint64(32)
            null = np.asarray(b.column(2).is_null())
            size = np.maximum(b.column(2).fill_null(0).to_numpy(zero_copy_only=False), 0)
            parts = []
            for lo, hi in _groups(size.tolist()):
                x = np.repeat(start[lo:hi], size[lo:hi]) + _within(size[lo:hi]).view(np.uint64)
                parts.append(letters[(double_hash64_np(x, seed)[0] >> np.uint64(62)).astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([b.column(0), _strings(parts, size, null)], ["rec", "seq"])

    d = df.select(F.col(rec).alias("rec"), key.alias("key"), n.cast("bigint").alias("n"))
    return d.mapInArrow(run, f"rec {kind}, seq string")


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, .. in each of stretches of these sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


STEP, SALT, TURN = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D


def _draws(key: np.ndarray, i: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each key and position."""
    with np.errstate(over="ignore"):
        z = remix_np(i.astype(np.uint64) * np.uint64(STEP) + key * np.uint64(STEP) + np.uint64(salt * SALT & MASK64))
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


#: The bases that may take an ASCII character's place, and how many.
_CHANGED = ["ACGT".replace(chr(c).upper(), "").encode() for c in range(128)]
_COUNT, _OTHERS = np.array([len(x) for x in _CHANGED]), np.array([[*x, 0][:4] for x in _CHANGED], np.uint8)


def _substituted(raw: np.ndarray, size: np.ndarray, hit: np.ndarray, of: np.ndarray, base: np.ndarray) -> tuple[pa.Array, np.ndarray, list[str]]:
    """(sequences, substitutions, cigars) of ASCII sequences in a row, where every hit is a substitution."""
    out = raw.copy()
    out[hit] = _OTHERS[raw[hit], (base * _COUNT[raw[hit]]).astype(np.int64)]
    count = np.bincount(of, minlength=len(size))
    end = np.cumsum(size)
    begin = end - size
    # Runs begin at a record's begin, at a hit without one before it, and after a hit that has none after it.
    x = np.zeros(len(raw) + 1, bool)
    x[hit] = True
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = x[1:-1] != x[:-2]
    edge[begin[size > 0]] = True
    edge[len(raw)] = False
    at = np.flatnonzero(edge)
    length = np.diff(at, append=len(raw)).tolist()
    runs = [f"{n}{'X' if v else 'M'}" for n, v in zip(length, x[at].tolist())]
    split = np.searchsorted(at, np.append(begin, len(raw))).tolist()
    return _strings([out], size), count, ["".join(runs[i:j]) for i, j in zip(split, split[1:])]


def _walk(seq: str, hits: list[int], kind: list[float], length: list[int], inserted: list[str | None], base: list[float], indel_fraction: float) -> tuple[str, int, int, int, int, str]:
    """(sequence, substitutions, insertions, deletions, inserted minus deleted bases, cigar) of one sequence, hit by hit."""
    n = len(seq)
    out: list[str] = []
    ops: list[list] = []
    sub = ins = dele = net = at = 0

    def op(size: int, what: str) -> None:
        if ops and ops[-1][1] == what:
            ops[-1][0] += size
        else:
            ops.append([size, what])

    def copy(to: int) -> None:
        nonlocal at
        if to > at:
            out.append(seq[at:to])
            op(to - at, "M")
            at = to

    for h, i in enumerate(hits):
        if i < at:  # within a deletion
            continue
        copy(i)
        if kind[h] >= indel_fraction:
            others = "ACGT".replace(seq[i].upper(), "")
            out.append(others[int(base[h] * len(others))])
            op(1, "X")
            sub, at = sub + 1, i + 1
        elif inserted[h] is not None:
            out.append(inserted[h])
            op(length[h], "I")
            ins, net = ins + 1, net + length[h]
            copy(i + 1)
        else:
            op(length[h], "D")
            dele, net, at = dele + 1, net - length[h], i + length[h]
    copy(n)
    return "".join(out), sub, ins, dele, net, "".join(f"{a}{b}" for a, b in ops)


def _mutated(keys: np.ndarray, texts: list[str], rate: float, indel_fraction: float, extension: float, longest: int | None) -> Iterator[tuple]:
    """Columns of mutated sequences, block by block: positions are drawn for all of a block at once, the rest for its hits."""
    sizes = [len(s) for s in texts]
    for lo, hi in _groups(sizes):
        size, key = np.array(sizes[lo:hi], np.int64), keys[lo:hi]
        place = _within(size)
        hit = np.flatnonzero(_draws(np.repeat(key, size), place, 0) < rate)
        of, i = np.repeat(np.arange(len(size)), size)[hit], place[hit]
        k = key[of]
        base = _draws(k, i, 4)
        joined = "".join(texts[lo:hi])
        if indel_fraction == 0 and joined.isascii():
            seq, sub, cigar = _substituted(np.frombuffer(joined.encode(), np.uint8), size, hit, of, base)
            none = np.zeros(len(size), np.int64)
            yield seq, pa.array(sub, pa.int64()), *[pa.array(none)] * 3, pa.array(cigar, pa.string())
            continue
        kind, side, grow = (_draws(k, i, salt) for salt in (1, 2, 3))
        length, indel = np.zeros(len(i), np.int64), np.flatnonzero(kind < indel_fraction)
        for h, most, g in zip(indel.tolist(), (size[of] - i)[indel].tolist(), grow[indel].tolist()):
            most = most if longest is None else min(most, longest)
            more = 0 if extension == 0 else most if extension == 1 else int(math.log(1 - g) / math.log(extension))
            length[h] = min(most, 1 + more)
        inserted: list[str | None] = [None] * len(i)
        new = indel[side[indel] < 0.5]
        with np.errstate(over="ignore"):
            turned = k[new] ^ (i[new] + 1).astype(np.uint64) * np.uint64(TURN)
        picks = _draws(np.repeat(turned, length[new]), _within(length[new]), 5)
        bases, at = _BASES[(picks * 4).astype(np.int64)].tobytes().decode(), 0
        for h, n in zip(new.tolist(), length[new].tolist()):
            inserted[h] = bases[at : at + n]
            at += n
        split = np.searchsorted(of, np.arange(len(size) + 1)).tolist()
        i, kind, base, length = i.tolist(), kind.tolist(), base.tolist(), length.tolist()
        rows = [_walk(s, i[a:b], kind[a:b], length[a:b], inserted[a:b], base[a:b], indel_fraction) for s, a, b in zip(texts[lo:hi], split, split[1:])]
        yield tuple(pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int64()] * 4, pa.string()]))


_BASES = np.frombuffer(b"ACGT", np.uint8)


def mutate(df: DataFrame, rate: float, indel_fraction: float = 0.0, extension: float = 0.0, seed: int = 42, rec: str = "rec", seq: str = "seq", longest: int | None = None) -> DataFrame:
    """(rec, seq, substitutions, insertions, deletions, indel_bases, cigar) per record.

    Each base is hit with probability rate: by a substitution, always with another
    base, or, with indel_fraction, half and half by an insertion of bases before it
    or a deletion from it on; each further base comes with probability extension, up to ``longest`` bases if
    given and to as many as the rest of the sequence has.
    Hits inside a deletion are void. Null sequences give no row; rates outside 0
    to 1 raise. Records are mutated apart, many in a kernel's block, so nothing is shuffled.
    """
    if not all(0 <= p <= 1 for p in (rate, indel_fraction, extension)):
        raise ValueError("rates lie between 0 and 1")
    kind, key = _key(df, rec)

    names = ["rec", "seq", "substitutions", "insertions", "deletions", "indel_bases", "cigar"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = double_hash64_np(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), seed)[0], 0
            for cols in _mutated(keys, b.column(2).to_pylist(), rate, indel_fraction, extension, longest):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(cols[0])), *cols], names)
                at += len(cols[0])

    d = df.where(F.col(seq).isNotNull()).select(F.col(rec).alias("rec"), key.alias("key"), F.col(seq).alias("seq"))
    return d.mapInArrow(run, f"rec {kind}, seq string, substitutions bigint, insertions bigint, deletions bigint, indel_bases bigint, cigar string")
