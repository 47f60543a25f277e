"""64- and 128-bit hashes of integers and bytes.

Spark's arithmetic raises on overflow, so wrap-around products run in numpy on
Arrow batches. Unsigned results are BIGINTs with the same bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
MASK32, MASK64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def double_hash64_np(values: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both words of the 128-bit murmur hash of 8-byte little-endian keys; the seed counts modulo 2**32."""
    with np.errstate(over="ignore"):
        s = np.uint64(seed & MASK32)
        k = _rot(values.astype(np.uint64, copy=False) * C1, 31) * C2
        a, b = (s ^ k) ^ np.uint64(8), np.broadcast_to(s ^ np.uint64(8), k.shape)
        a = a + b
        b = b + a
        a, b = _mix(a), _mix(b)
        a = a + b
        return a, b + a


def remix_np(z: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection that spreads low bits."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _longs(x: pa.Array, f) -> pa.Array:
    """f over the valid values; nulls stay."""
    filled = x.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    return pa.array(f(filled.view(np.uint64)).view(np.int64), pa.int64(), mask=np.asarray(x.is_null()))


def hash64(value: Column, seed: int = 0) -> Column:
    """First word of the 128-bit hash of a BIGINT; null stays null."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        return _longs(x, lambda v: double_hash64_np(v, seed)[0])

    return run(value.cast("bigint"))


def double_hash64(value: Column, seed: int = 0) -> Column:
    """Both words as STRUCT<h1, h2>."""

    @F.arrow_udf("h1 bigint, h2 bigint")
    def run(x: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_longs(x, lambda v: double_hash64_np(v, seed)[0]), _longs(x, lambda v: double_hash64_np(v, seed)[1])], ["h1", "h2"])

    return run(value.cast("bigint"))


def remix(value: Column) -> Column:
    @F.arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        return _longs(x, remix_np)

    return run(value.cast("bigint"))


def _fmix(h: int, bits: int) -> int:
    if bits == 64:
        for m in (int(M1), int(M2)):
            h = (h ^ (h >> 33)) * m & MASK64
        return h ^ (h >> 33)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & MASK32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & MASK32
    return h ^ (h >> 16)


def murmur128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """The 128-bit hash (64-bit lanes) of any bytes."""
    rot = lambda x, r: (x << r | x >> (64 - r)) & MASK64
    c1, c2 = int(C1), int(C2)
    lane1 = lambda k: rot(k * c1 & MASK64, 31) * c2 & MASK64
    lane2 = lambda k: rot(k * c2 & MASK64, 33) * c1 & MASK64
    a = b = seed & MASK32
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        a = (rot(a ^ lane1(int.from_bytes(data[i : i + 8], "little")), 27) + b) * 5 + 0x52DCE729 & MASK64
        b = (rot(b ^ lane2(int.from_bytes(data[i + 8 : i + 16], "little")), 31) + a) * 5 + 0x38495AB5 & MASK64
    tail = data[whole:]
    b ^= lane2(int.from_bytes(tail[8:], "little"))
    a ^= lane1(int.from_bytes(tail[:8], "little"))
    a, b = a ^ len(data), b ^ len(data)
    a = a + b & MASK64
    b = b + a & MASK64
    a, b = _fmix(a, 64), _fmix(b, 64)
    a = a + b & MASK64
    return a, b + a & MASK64


def murmur32(data: bytes, seed: int = 0) -> int:
    """The 32-bit hash of any bytes."""
    rot = lambda x, r: (x << r | x >> (32 - r)) & MASK32
    lane = lambda k: rot(k * 0xCC9E2D51 & MASK32, 15) * 0x1B873593 & MASK32
    h, whole = seed & MASK32, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = rot(h ^ lane(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64 & MASK32
    return _fmix(h ^ lane(int.from_bytes(data[whole:], "little")) ^ len(data), 32)


def murmur128_x86(data: bytes, seed: int = 0) -> tuple[int, int, int, int]:
    """The 128-bit hash of any bytes in four 32-bit lanes."""
    rot = lambda x, r: (x << r | x >> (32 - r)) & MASK32
    c = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
    turn, step, add = (15, 16, 17, 18), (19, 17, 15, 13), (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
    lane = lambda i, k: rot(k * c[i] & MASK32, turn[i]) * c[(i + 1) % 4] & MASK32
    h, whole = [seed & MASK32] * 4, len(data) // 16 * 16
    for at in range(0, whole, 16):
        for i in range(4):
            x = rot(h[i] ^ lane(i, int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little")), step[i])
            h[i] = (x + h[(i + 1) % 4]) * 5 + add[i] & MASK32
    tail = data[whole:]
    h = [(x ^ lane(i, int.from_bytes(tail[4 * i : 4 * i + 4], "little"))) ^ len(data) for i, x in enumerate(h)]
    for _ in range(2):
        h[0] = sum(h) & MASK32
        h[1:] = [x + h[0] & MASK32 for x in h[1:]]
        if _ == 0:
            h = [_fmix(x, 32) for x in h]
    return tuple(h)


def murmur128_np(rows: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both words of the 128-bit hash of equally long byte strings, the rows of a table of bytes."""
    count, size = rows.shape
    wide = np.zeros((count, -(-max(size, 1) // 16) * 16), np.uint8)
    wide[:, :size] = rows
    words = wide.view("<u8")
    with np.errstate(over="ignore"):
        lane1 = lambda k: _rot(k * C1, 31) * C2
        lane2 = lambda k: _rot(k * C2, 33) * C1
        a = np.full(count, seed & MASK32, np.uint64)
        b, five = a.copy(), np.uint64(5)
        for i in range(size // 16):
            a = (_rot(a ^ lane1(words[:, 2 * i]), 27) + b) * five + np.uint64(0x52DCE729)
            b = (_rot(b ^ lane2(words[:, 2 * i + 1]), 31) + a) * five + np.uint64(0x38495AB5)
        if size % 16:  # zero bytes beyond the end change nothing
            a, b = a ^ lane1(words[:, -2]), b ^ lane2(words[:, -1])
        a, b = a ^ np.uint64(size), b ^ np.uint64(size)
        a = a + b
        b = b + a
        a, b = _mix(a), _mix(b)
        a = a + b
        return a, b + a


def _rot32(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def murmur32_np(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 32-bit hash of 8-byte little-endian keys."""
    h = np.full(len(values), seed & MASK32, np.uint32)
    with np.errstate(over="ignore"):
        for k in (values & np.uint64(MASK32), values >> np.uint64(32)):
            k = _rot32(k.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = _rot32(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        return _mix32(h ^ np.uint32(8))


def murmur128_x86_np(values: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """The 128-bit hash of 8-byte little-endian keys in four 32-bit lanes."""
    c = [np.uint32(x) for x in (0x239B961B, 0xAB0E9789, 0x38B34AE5)]
    low, high = (values & np.uint64(MASK32)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    s = np.full(len(values), seed & MASK32, np.uint32)
    with np.errstate(over="ignore"):
        h = [s ^ _rot32(low * c[0], 15) * c[1], s ^ _rot32(high * c[1], 16) * c[2], s, s]
        h = [x ^ np.uint32(8) for x in h]
        for last in (False, True):
            h[0] = h[0] + h[1] + h[2] + h[3]
            h[1:] = [x + h[0] for x in h[1:]]
            h = h if last else [_mix32(x) for x in h]
    return h


def hash32(value: Column, seed: int = 0) -> Column:
    """The 32-bit hash of a BIGINT, as a BIGINT."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        return _longs(x, lambda v: murmur32_np(v, seed).astype(np.uint64))

    return run(value.cast("bigint"))


def hash128_x86(value: Column, seed: int = 0) -> Column:
    """The four 32-bit lanes of the 128-bit hash of a BIGINT as STRUCT<h1, h2, h3, h4>."""

    @F.arrow_udf("h1 bigint, h2 bigint, h3 bigint, h4 bigint")
    def run(x: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_longs(x, lambda v, i=i: murmur128_x86_np(v, seed)[i].astype(np.uint64)) for i in range(4)], ["h1", "h2", "h3", "h4"])

    return run(value.cast("bigint"))


def hash_bytes(value: Column, seed: int = 0) -> Column:
    """First word of the 128-bit hash of a string's or binary's bytes."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        texts = x.to_pylist()
        size = np.array([-1 if t is None else len(t) for t in texts])
        out = np.zeros(len(texts), np.int64)
        for n in np.unique(size[size >= 0]).tolist():  # equal lengths at once
            at = np.flatnonzero(size == n)
            rows = np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), n)
            out[at] = murmur128_np(rows, seed)[0].view(np.int64)
        return pa.array(out, pa.int64(), mask=size < 0)

    return run(value.cast("binary"))


def fastrange(word: Column, p: Column | int, bits: int = 64) -> Column:
    """(word * p) >> bits without bias or division; p below 256. BIGINT words count as unsigned."""
    p = F.lit(p) if isinstance(p, int) else p
    if bits <= 32:
        return F.shiftrightunsigned(word.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1)) * p.cast("bigint"), bits)
    # Halves, so that no product leaves 63 bits.
    high, low = F.shiftrightunsigned(word, 32), word.bitwiseAND(F.lit(MASK32))
    p = p.cast("bigint")
    return F.shiftrightunsigned(high * p + F.shiftrightunsigned(low * p, 32), 32)


def unsigned(value: Column) -> Column:
    """A BIGINT that orders as value's bits do unsigned."""
    return value.bitwiseXOR(F.lit(-(1 << 63)))
