"""Packed k-mers, minimizers, super-k-mers, syncmers and hash samples of sequences.

Hashes need wrap-around arithmetic, so Arrow kernels compute them together with the
sliding minima, over blocks of many records that a break keeps apart: everything about
a record is local to its row, and no m-mer is ever shuffled or sorted. What a query asks
of a record's rows (``fold``) or of all rows by a value (``tally``) is reduced where the
rows are made, so that only the results leave the kernel.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encoding import clean_bytes
from strandloom.functions.hashing import MASK32, double_hash64_np

#: 0 to 3, 4 for a break in a sequence, 5 for the end of one in a block.
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT\0", np.uint8)] = [0, 1, 2, 3, 5]

#: Windows of a long sequence that are packed at once, bases of a block of records, rows that leave a kernel at once.
CHUNK, BLOCK, ROWS = 1 << 20, 1 << 16, 1 << 18
#: Values up to this are counted in a table, hashes of m-mers up to this length looked up in one.
TABLE, TABLE_M = 1 << 22, 9

#: Result -> (aggregate, what is aggregated, from the columns of rows); counts take no function.
Fold = dict[str, tuple[str, Callable[[dict[str, np.ndarray]], np.ndarray] | None]]


def packed(seq: bytes, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(values, valid) of all windows of a cleaned sequence; k up to 32."""
    return packed_codes(_CODE[np.frombuffer(seq, np.uint8)], k, canonical)


def packed_codes(code: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(values, valid) of all windows of codes; windows of 2, 4, 8.. bases are made of halves."""
    n, kind = len(code) - k + 1, np.uint32 if k <= 16 else np.uint64
    if n <= 0:
        return np.zeros(0, kind), np.zeros(0, bool)
    part = (code & 3).astype(kind)
    back = part ^ kind(3) if canonical else None
    value = rc = None
    done, width = 0, 1
    while True:
        if k & width:  # the next width bases of each window
            p = part[done : done + n]
            value = p.copy() if value is None else (value << kind(2 * width)) | p
            if canonical:
                r = back[done : done + n]
                rc = r.copy() if rc is None else rc | (r << kind(2 * done))
            done += width
        if done == k:
            break
        part = (part[:-width] << kind(2 * width)) | part[width:]
        if canonical:
            back = back[:-width] | (back[width:] << kind(2 * width))
        width *= 2
    if canonical:
        np.minimum(value, rc, out=value)
    return value, _unbroken(code > 3, k)


def _unbroken(bad: np.ndarray, k: int) -> np.ndarray:
    """Whether none of each k consecutive values is bad."""
    seen = np.zeros(len(bad) + 1, np.int32)
    np.cumsum(bad, out=seen[1:])
    return seen[k:] == seen[:-k]


@functools.lru_cache(4)
def _hash_table(m: int, seed: int) -> np.ndarray:
    return double_hash64_np(np.arange(4**m, dtype=np.uint64), seed)[0]


@functools.lru_cache(4)
def _rank_table(m: int, seed: int) -> np.ndarray:
    """Ranks of the hashes of all m-mers, 32 bits to the left."""
    return np.unique(_hash_table(m, seed), return_inverse=True)[1].astype(np.int64) << 32


def hashes(value: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Hashes of packed m-mers."""
    return _hash_table(m, seed)[value] if m <= TABLE_M else double_hash64_np(value, seed)[0]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, from those of 2, 4, 8.. of them."""
    n, width = len(x) - w + 1, 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least of each w consecutive values."""
    n = len(h) - w + 1
    best, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        less = h[j : j + n] < best
        np.copyto(best, h[j : j + n], where=less)
        np.copyto(at, j, where=less)
    return at + np.arange(n)


def window_minima(code: np.ndarray, k: int, m: int, seed: int, canonical: bool) -> tuple[np.ndarray, ...]:
    """(k-mer position, minimizer's position, its value, its hash) of each k-mer without a break."""
    value, valid = packed_codes(code, m, canonical)
    w, none = k - m + 1, np.zeros(0, np.int64)
    if len(value) < w:
        return none, none, none, none.astype(np.uint64)
    pos = np.flatnonzero(_unbroken(~valid, w))
    if m <= TABLE_M:
        # A hash's rank before the place: the least of them is the leftmost least.
        least = _least(_rank_table(m, seed)[value] | np.arange(len(value)), w)
        at = least[pos] & MASK32
        return pos, at, value[at], _hash_table(m, seed)[value[at]]
    h = hashes(value, m, seed)
    at = sliding_min(h, w)[pos]
    return pos, at, value[at], h[at]


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the stretches of x that begin at ``at``; one that leaves 64 bits raises."""
    x = x.astype(np.int64, copy=False)
    out = np.add.reduceat(x, at)
    if max(-int(x.min()), int(x.max())) * len(x) >= 2**63:
        high, low = np.add.reduceat(x >> 32, at), np.add.reduceat(x & MASK32, at)
        if (high + (low >> 32) != out >> 32).any():
            raise OverflowError("a record's sum leaves 64 bits")
    return out


def _distinct(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of distinct values in the stretches of x that begin at ``at``."""
    return np.array([1 + np.count_nonzero(np.diff(np.sort(part))) for part in np.split(x, at[1:])])


_REDUCE = {"distinct": _distinct, "sum": _sums, "min": np.minimum.reduceat, "max": np.maximum.reduceat, "bit_xor": np.bitwise_xor.reduceat}
_COMBINE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "bit_xor": F.bit_xor}


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False)


class _Kernel:
    """Rows of sequences by a kernel over blocks of codes.

    kernel(codes) gives, in ascending order, the places of the rows in the block, then
    their columns; those named in ``places`` are places in the block too and become
    positions in the record. A column ``id`` isn't asked of the kernel: it numbers a
    record's rows. A record of more windows than chunk is cut into parts that overlap by
    k - 1 bases, and with ``back`` by the window before, whose own row is left out there;
    without chunk a record is whole, however long. ``gaps`` names a column with -1 for null.
    """

    def __init__(self, k: int, columns: str, kernel, read, places: tuple[str, ...] = (), chunk: int | None = None, back: int = 0, tail: int = 0, gaps: str | None = None):
        self.k, self.columns, self.names = k, columns, [c.split()[0] for c in columns.split(", ")]
        self.kernel, self.read, self.places, self.chunk, self.back, self.tail, self.gaps = kernel, read, places, chunk, back, tail, gaps

    def blocks(self, seqs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
        """(record numbers in the batch, how many rows each has, columns of the rows); a record may come in parts."""
        recs: list[int] = []
        first: list[int] = []  # positions in the records
        parts: list[bytes] = []
        size, ids = 0, [-1, 0]  # the last record, and its rows so far
        for i, s in enumerate(seqs):
            s = self.read(s.as_py()) if s.is_valid else b""
            windows = len(s) - self.tail - self.k + 1
            step = self.chunk or windows
            for at in range(0, windows, max(1, step)):
                begin = max(0, at - self.back)
                recs.append(i)
                first.append(begin)
                parts.append(s[begin : min(at + step, windows) + self.k - 1])
                size += len(parts[-1]) + 1
                if size >= BLOCK:
                    yield self.block(recs, first, parts, ids)
                    recs, first, parts, size = [], [], [], 0
        if recs:
            yield self.block(recs, first, parts, ids)

    def block(self, recs: list[int], first: list[int], parts: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        code = _CODE[np.frombuffer(b"\0".join([*parts, b""]), np.uint8)]
        begin = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
        rows, *found = self.kernel(code)
        if self.back and any(first):
            own = np.flatnonzero(~np.isin(rows, begin[:-1][np.array(first) > 0]))
            rows, found = rows[own], [x[own] for x in found]
        split = np.searchsorted(rows, begin)
        count = np.diff(split)
        cols = dict(zip((n for n in self.names if n != "id"), map(_longs, found)))
        if self.places:
            shift = np.repeat(begin[:-1] - np.array(first), count)
            cols |= {n: cols[n] - shift for n in self.places}
        if "id" in self.names:
            base = split[:-1].copy()
            for j, i in enumerate(recs):
                before = ids[1] if ids[0] == i else 0
                base[j] -= before
                ids[:] = i, before + int(count[j])
            cols["id"] = np.arange(len(rows)) - np.repeat(base, count)
        return np.array(recs), count, cols

    def rows(self, df: DataFrame) -> DataFrame:
        """(rec, *columns): every row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for recs, count, cols in self.blocks(b.column(1)):
                    take = pa.array(np.repeat(recs, count))
                    out = [pa.array(cols[n], mask=cols[n] < 0 if n == self.gaps else None) for n in self.names]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), *out], ["rec", *self.names])

        return df.mapInArrow(run, f"rec {_kind(df)}, {self.columns}")

    def each(self, df: DataFrame, fold: Fold) -> DataFrame:
        """(rec, *results): what fold asks of the rows of each record, or of each part of one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list[np.ndarray]] = []
                for recs, count, cols in self.blocks(b.column(1)):
                    has = np.flatnonzero(count)
                    if len(has):
                        at = (np.cumsum(count) - count)[has]
                        out.append([recs[has], *[count[has] if how == "count" else _REDUCE[how](f(cols), at) for how, f in fold.values()]])
                if out:
                    recs, *found = map(np.concatenate, zip(*out))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(recs)), *[pa.array(_longs(x)) for x in found]], ["rec", *fold])

        return df.mapInArrow(run, ", ".join([f"rec {_kind(df)}", *[f"{n} bigint" for n in fold]]))

    def fold(self, df: DataFrame, fold: Fold) -> DataFrame:
        """(rec, *results): what fold asks of each record's rows. Parts meet, and rows of df with the same record."""
        return self.each(df, fold).groupBy("rec").agg(*[_COMBINE[how](n).alias(n) for n, (how, _) in fold.items()])

    def tally(self, df: DataFrame, column: str, universe: int) -> DataFrame:
        """(column, count): how many rows have a value from 0 to universe - 1; a value comes several times, with parts of its count."""

        def cut(value: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(value), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(value[i : i + ROWS]), pa.array(count[i : i + ROWS])], [column, "count"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(universe, np.int64) if universe <= TABLE else None
            held: list[np.ndarray] = []
            size = 0
            for b in batches:
                for _, _, cols in self.blocks(b.column(1)):
                    if table is not None:
                        np.add.at(table, cols[column], 1)
                        continue
                    held.append(cols[column])
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield from cut(*np.unique(np.concatenate(held), return_counts=True))
                        held, size = [], 0
            if held:
                yield from cut(*np.unique(np.concatenate(held), return_counts=True))
            if table is not None:
                value = np.flatnonzero(table)
                yield from cut(value, table[value])

        return df.mapInArrow(run, f"{column} bigint, count bigint")


def _kind(df: DataFrame) -> str:
    return df.schema["rec"].dataType.simpleString()


def _sequences(df: DataFrame, rec: str, seq: str) -> DataFrame:
    return df.select(F.col(rec).alias("rec"), F.col(seq).cast("binary").alias("seq"))


def _found(kernel: _Kernel, df: DataFrame, rec: str, seq: str, fold: Fold | None) -> DataFrame:
    d = _sequences(df, rec, seq)
    return kernel.rows(d) if fold is None else kernel.fold(d, fold)


def _packed(k: int, canonical: bool, read, chunk: int | None = CHUNK, tail: int = 0) -> _Kernel:
    def kernel(code: np.ndarray) -> tuple[np.ndarray, ...]:
        value, valid = packed_codes(code, k, canonical)
        pos = np.flatnonzero(valid)
        return pos, value[pos], pos

    return _Kernel(k, "value bigint, position bigint", kernel, read, ("position",), chunk, tail=tail)


def packed_kmers(df: DataFrame, k: int, canonical: bool = False, reference_tail: bool = False, rec: str = "rec", seq: str = "seq", chunk: int = CHUNK, read=clean_bytes, fold: Fold | None = None) -> DataFrame:
    """(rec, value, position) of every window without a break, packed: two bits a base, k up to 31.

    The order of values is that of the k-mers as strings. reference_tail leaves out a
    window that ends at the sequence's last base. Null and short sequences give no row.
    """
    return _found(_packed(k, canonical, read, chunk, int(reference_tail)), df, rec, seq, fold)


def kmer_counts(df: DataFrame, k: int, canonical: bool = False, rec: str = "rec", seq: str = "seq", read=clean_bytes) -> DataFrame:
    """(value, count) of the packed k-mers of all records; a value comes several times, with parts of its count."""
    return _packed(k, canonical, read).tally(_sequences(df, rec, seq), "value", 4**k)


def kmer_arrays(k: int, canonical: bool, read) -> Callable[[pa.Array], list[np.ndarray]]:
    """A function from an array of UTF-8 sequences to the packed k-mers of each, without an order."""
    kernel, kind = _packed(k, canonical, read, None), np.uint32 if k <= 15 else np.uint64

    def arrays(seqs: pa.Array) -> list[np.ndarray]:
        out = [np.zeros(0, kind)] * len(seqs)
        for recs, count, cols in kernel.blocks(seqs):
            for i, v in zip(recs.tolist(), np.split(cols["value"].astype(kind), np.cumsum(count)[:-1])):
                out[i] = v
        return out

    return arrays


def distinct_in_row(df: DataFrame, k: int, canonical: bool = False, rec: str = "rec", seq: str = "seq", read=clean_bytes) -> DataFrame:
    """(rec, distinct_kmers) of each row with a k-mer, without any shuffle."""
    return _packed(k, canonical, read, None).each(_sequences(df, rec, seq), {"distinct_kmers": ("distinct", lambda c: c["value"])})


def packed_with_breaks(df: DataFrame, k: int, canonical: bool = False, rec: str = "rec", seq: str = "seq", chunk: int = CHUNK, read=clean_bytes, fold: Fold | None = None) -> DataFrame:
    """(rec, value, position, id): packed k-mers and, after a k-mer, one null row for each run of breaks; ids count both, in each row of df.

    A break row's position is that of the window whose last character breaks. To a fold its value is -1.
    """

    def kernel(code: np.ndarray) -> tuple[np.ndarray, ...]:
        value, valid = packed_codes(code, k, canonical)
        shown = valid.copy()
        shown[1:] |= valid[:-1] & (code[k:] == 4)
        pos = np.flatnonzero(shown)
        return pos, np.where(valid[pos], value[pos].astype(np.int64), -1), pos

    return _found(_Kernel(k, "value bigint, position bigint, id bigint", kernel, read, ("position",), chunk, back=1, gaps="value"), df, rec, seq, fold)


def kmer_sets(df: DataFrame, k: int, canonical: bool = False, multiset: bool = False, rec: str = "rec", seq: str = "seq", read=clean_bytes) -> DataFrame:
    """(rec, values, counts): the distinct packed k-mers of each record, ascending; counts are 1 without multiset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(b.column(1).to_pylist()):
                value, valid = packed(read(s or b""), k, canonical)
                v, c = np.unique(value[valid].astype(np.int64), return_counts=True)
                c = c if multiset else np.ones(len(v), np.int64)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), one(v), one(c)], ["rec", "values", "counts"])

    d = _sequences(df, rec, seq)
    return d.mapInArrow(run, f"rec {_kind(d)}, values array<bigint>, counts array<bigint>")


def _changes(at: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Where another minimizer starts: another place, or after a break."""
    return np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (pos[1:] != pos[:-1] + 1)])) if len(at) else at


def minimizers(df: DataFrame, k: int, m: int, seed: int = 42, canonical: bool = False, rec: str = "rec", seq: str = "seq", chunk: int = CHUNK, read=clean_bytes, fold: Fold | None = None) -> DataFrame:
    """(rec, value, hash, position, id): the leftmost least-hashed m-mer of each k-mer, equal neighbours once."""

    def kernel(code: np.ndarray) -> tuple[np.ndarray, ...]:
        pos, at, value, h = window_minima(code, k, m, seed, canonical)
        c = _changes(at, pos)
        return pos[c], value[c], h[c], at[c]

    return _found(_Kernel(k, "value bigint, hash bigint, position bigint, id bigint", kernel, read, ("position",), chunk, back=1), df, rec, seq, fold)


def super_kmers(df: DataFrame, k: int, m: int, seed: int = 42, canonical: bool = False, rec: str = "rec", seq: str = "seq", read=clean_bytes, fold: Fold | None = None) -> DataFrame:
    """(rec, minimizer, mm_pos, size, start): runs of k-mers that share a minimizer; breaks end a run."""

    def kernel(code: np.ndarray) -> tuple[np.ndarray, ...]:
        pos, at, value, _ = window_minima(code, k, m, seed, canonical)
        c = _changes(at, pos)
        return pos[c], value[c], at[c] - pos[c], np.diff(np.concatenate([c, [len(at)]])), pos[c]

    return _found(_Kernel(k, "minimizer bigint, mm_pos bigint, size bigint, start bigint", kernel, read, ("start",)), df, rec, seq, fold)


def _offsets(k: int, m: int, canonical: bool, seed: int, read, chunk: int = CHUNK, only: tuple[int, ...] | None = None) -> _Kernel:
    def kernel(code: np.ndarray) -> tuple[np.ndarray, ...]:
        pos, at, _, _ = window_minima(code, k, m, seed, False)
        offset = at - pos
        if only is not None:
            kept = np.flatnonzero(np.isin(offset, only))
            pos, offset = pos[kept], offset[kept]
        return pos, packed_codes(code, k, canonical)[0][pos], pos, offset

    return _Kernel(k, "value bigint, position bigint, offset bigint", kernel, read, ("position",), chunk)


def minimizer_offsets(df: DataFrame, k: int, m: int, canonical: bool = False, seed: int = 0, rec: str = "rec", seq: str = "seq", chunk: int = CHUNK, read=clean_bytes, fold: Fold | None = None) -> DataFrame:
    """(rec, value, position, offset): each k-mer and where in it its least m-mer lies."""
    return _found(_offsets(k, m, canonical, seed, read, chunk), df, rec, seq, fold)


def offset_counts(df: DataFrame, k: int, m: int, seed: int = 0, rec: str = "rec", seq: str = "seq", read=clean_bytes) -> DataFrame:
    """(offset, count): how many k-mers have their least m-mer there; an offset comes several times, with parts of its count."""
    return _offsets(k, m, False, seed, read).tally(_sequences(df, rec, seq), "offset", k - m + 1)


def syncmers(df: DataFrame, k: int, m: int, first: int = 0, second: int | None = None, canonical: bool = False, rec: str = "rec", seq: str = "seq", read=clean_bytes, fold: Fold | None = None) -> DataFrame:
    """k-mers whose least m-mer lies at one of two offsets: closed syncmers by default, open ones with first == second."""
    return _found(_offsets(k, m, canonical, 0, read, only=(first, k - m if second is None else second)), df, rec, seq, fold)


def threshold(rate: float) -> int:
    """Hashes below this are kept; a rate outside 0 to 1 raises."""
    if not 0 <= rate <= 1:
        raise ValueError("a sampling rate lies between 0 and 1")
    return int(rate * 2**64)


def hash_sample(df: DataFrame, k: int, rate: float, seed: int = 42, canonical: bool = True, rec: str = "rec", seq: str = "seq", read=clean_bytes, fold: Fold | None = None) -> DataFrame:
    """(rec, value, position): k-mers whose hash lies below a share of the range, the same ones in every record."""
    limit = threshold(rate)

    def kernel(code: np.ndarray) -> tuple[np.ndarray, ...]:
        value, valid = packed_codes(code, k, canonical)
        keep = valid if limit >= 2**64 else valid & (hashes(value, k, seed) < np.uint64(limit))
        pos = np.flatnonzero(keep)
        return pos, value[pos], pos

    return _found(_Kernel(k, "value bigint, position bigint", kernel, read, ("position",), CHUNK), df, rec, seq, fold)
