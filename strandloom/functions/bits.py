"""Bit operations on 64-bit words, as Columns. Null in, null out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    return F.bit_count(x.cast("bigint"))


def parity(x: Column) -> Column:
    return popcount(x).bitwiseAND(F.lit(1))


def lsb(x: Column) -> Column:
    """Index of the lowest one; null for zero."""
    b = F.bin(x.cast("bigint"))
    return F.when(x != 0, F.length(b) - F.length(F.rtrim(b, F.lit("0"))))


def msb(x: Column) -> Column:
    """Index of the highest one, floor(log2 x) unsigned; null for zero."""
    return F.when(x != 0, F.length(F.bin(x.cast("bigint"))) - 1)


def low_mask(n: Column) -> Column:
    """n ones from bit 0, n from 0 to 64."""
    return F.when(n >= 64, F.lit(-1)).when(n <= 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (64 - n).cast("int")))


def word_rank1(x: Column, pos: Column) -> Column:
    """Ones in bits 0..pos, pos included."""
    return F.bit_count(x.cast("bigint").bitwiseAND(low_mask(pos + 1).cast("bigint")))


def word_rank0(x: Column, pos: Column) -> Column:
    return (pos + 1 - word_rank1(x, pos)).cast("int")


def _select(x: Column, th: Column, bit: int) -> Column:
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(x.cast("bigint"), i) == bit)
    return F.get(ones, th.cast("int"))


def word_select1(x: Column, th: Column) -> Column:
    """Position of the th-th one, from 0; null where there are fewer."""
    return _select(x, th, 1)


def word_select0(x: Column, th: Column) -> Column:
    return _select(x, th, 0)


def bits_text(x: Column) -> Column:
    """64 binary digits, highest first."""
    return F.lpad(F.bin(x.cast("bigint")), 64, "0")


def bits_text_reverse(x: Column) -> Column:
    return F.reverse(bits_text(x))


#: Bits of a type's values.
WIDTHS = {"boolean": 1, "tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": 32, "double": 64}


def bit_width(kind: str) -> int:
    """Bits of a value of a fixed-width type; others raise."""
    if kind not in WIDTHS:
        raise TypeError(f"{kind} has no fixed width")
    return WIDTHS[kind]


def bytes_rank1(raw: Column, bit: Column) -> Column:
    """Ones in bits 0..bit of a byte string, lowest bit of a byte first; a bit past the end raises."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array, at: pa.Array) -> pa.Array:
        out = []
        for b, i in zip(x.to_pylist(), at.to_pylist()):
            if b is None or i is None:
                out.append(None)
                continue
            if not 0 <= i < 8 * len(b):
                raise IndexError(f"bit {i} of {8 * len(b)}")
            raw = np.frombuffer(b, np.uint8, i // 8 + 1)
            out.append(int(np.bitwise_count(raw[:-1]).sum()) + (int(raw[-1]) & (2 << i % 8) - 1).bit_count())
        return pa.array(out, pa.int64())

    return run(raw, bit.cast("bigint"))
