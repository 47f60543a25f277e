"""Scalar functions against plain Python and known values."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np
import pytest

from strandloom.functions import bits, encoding, hashing

GOLDEN = {42: {0: 4849139840249140547, 1: 15275724918586625092, 2: 7375948999905411168, 12345: 8367407816444978832, 2**64 - 1: 13161889351522953593}, 0: {0: 2945182322382062539, 1: 19144387141682250, 2: 15999073549620265128, 12345: 4382807090671069591, 2**64 - 1: 11593587578262711667}}


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("seed", [42, 0])
def test_hash64_known_values(spark, seed):
    rows = [(signed(k),) for k in GOLDEN[seed]] + [(None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x long").select(hashing.hash64(F.col("x"), seed)).collect()]
    assert got == [signed(v) for v in GOLDEN[seed].values()] + [None]


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**40))
@settings(max_examples=200, deadline=None)
def test_eight_byte_form_equals_the_general_hash(x, seed):
    a, b = hashing.double_hash64_np(np.array([x], np.uint64), seed)
    assert (int(a[0]), int(b[0])) == hashing.murmur128(x.to_bytes(8, "little"), seed)


def test_hashes_of_bytes(spark):
    assert hashing.murmur128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert hashing.murmur32(b"") == 0 and hashing.murmur32(b"hello") == 0x248BFA47
    assert hashing.murmur128_x86(b"") == (0, 0, 0, 0)
    df = spark.createDataFrame([("hello",), (None,)], "s string")
    assert [r[0] for r in df.select(hashing.hash_bytes(F.col("s"))).collect()] == [signed(0xCBD8A7B341BD9B02), None]


def test_hash_of_byte_strings(spark):
    """Every length around the block size against the scalar form; nulls stay."""
    texts = [bytes((7 * i + n) % 256 for i in range(n)) for n in range(70)] + [b"same", b"same"]
    df = spark.createDataFrame([(bytearray(t),) for t in texts] + [(None,)], "x binary")
    got = [r[0] for r in df.select(hashing.hash_bytes(F.col("x"), 42)).collect()]
    assert got == [signed(hashing.murmur128(t, 42)[0]) for t in texts] + [None]


def test_x86_hashes(spark):
    """8-byte keys against the scalar forms; nulls stay."""
    keys = [0, 1, -1, 2**62 + 12345, -(2**63), 987654321]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "x long")
    raw = [k.to_bytes(8, "little", signed=True) for k in keys]
    got = df.select(hashing.hash32(F.col("x"), 7).alias("a"), hashing.hash128_x86(F.col("x"), 7).alias("b")).collect()
    assert [r.a for r in got] == [hashing.murmur32(k, 7) for k in raw] + [None]
    assert [tuple(r.b) for r in got[:-1]] == [hashing.murmur128_x86(k, 7) for k in raw]


def test_widths():
    assert bits.bit_width("bigint") == 64 and bits.bit_width("boolean") == 1
    with pytest.raises(TypeError):
        bits.bit_width("string")


def test_remix(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (2,)], "x long").select(hashing.remix(F.col("x"))).collect()]
    assert got == [6238072747940578789, signed(15839785061582574730)]


def test_fastrange(spark):
    words = [0, 1, 2**64 - 1, 2**63, 12345678901234567890]
    df = spark.createDataFrame([(signed(w),) for w in words], "w long")
    for p in (1, 7, 255):
        assert [r[0] for r in df.select(hashing.fastrange(F.col("w"), p)).collect()] == [w * p >> 64 for w in words]
        assert [r[0] for r in df.select(hashing.fastrange(F.col("w"), p, 32)).collect()] == [(w & 0xFFFFFFFF) * p >> 32 for w in words]


def test_bits(spark):
    words = [0, 1, 8, 12, -(2**63), -1, 2**62 + 5]
    df = spark.createDataFrame([(w,) for w in words], "x long")
    x = F.col("x")
    for w, r in zip(words, df.select(bits.popcount(x), bits.parity(x), bits.lsb(x), bits.msb(x), bits.bits_text(x), bits.word_rank1(x, F.lit(63)), bits.word_rank1(x, F.lit(3)), bits.word_rank0(x, F.lit(3)), bits.word_select1(x, F.lit(1)), bits.word_select0(x, F.lit(0))).collect()):
        u = w % 2**64
        ones = [i for i in range(64) if u >> i & 1]
        zeros = [i for i in range(64) if not u >> i & 1]
        low = sum(i <= 3 for i in ones)
        assert tuple(r) == (len(ones), len(ones) % 2, min(ones, default=None), max(ones, default=None), f"{u:064b}", len(ones), low, 4 - low, ones[1] if len(ones) > 1 else None, zeros[0] if zeros else None)


def test_bytes_rank(spark):
    raw = bytes([0b10110001, 0xFF, 0])
    df = spark.createDataFrame([(bytearray(raw), i) for i in range(24)], "r binary, i int")
    got = [r[0] for r in df.select(bits.bytes_rank1(F.col("r"), F.col("i"))).collect()]
    flat = [raw[i // 8] >> i % 8 & 1 for i in range(24)]
    assert got == [sum(flat[: i + 1]) for i in range(24)]
    with pytest.raises(Exception, match="bit 24 of 24"):
        df.select(bits.bytes_rank1(F.col("r"), F.lit(24))).collect()


def test_encoding(spark):
    df = spark.createDataFrame([("acguTNßx",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(encoding.clean(F.col("s"))).collect()] == ["ACGTTNNN", "", None]
    k = spark.createDataFrame([("GATTACA",), ("T" * 31,)], "s string")
    s = F.col("s")
    got = k.select(encoding.pack(s), encoding.pack_wide(s), encoding.reverse_complement(s), encoding.canonical(s), encoding.unpack(encoding.pack(s), 7)).collect()
    assert got[0][0] == int("2033010", 4) and got[0][2] == "TGTAATC" and got[0][3] == "GATTACA" and got[0][4] == "GATTACA"
    assert got[1][0] == 4**31 - 1 == int(got[1][1])
