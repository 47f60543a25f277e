"""Universal integer codes as strings of 0 and 1, and their streams.

Encoding is Column arithmetic on binary digits. Decoding is a scan whose next
step depends on the last, so it runs in an Arrow function, a stream per row.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _low(x: Column, width: Column | int) -> Column:
    """The low ``width`` binary digits, lowest first."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(width <= 0, F.lit("")).otherwise(F.substring(F.rpad(F.reverse(F.bin(x.cast("bigint"))), 64, "0"), F.lit(1), width.cast("int")))


def _top(x: Column) -> Column:
    return F.length(F.bin(x.cast("bigint"))) - 1


def binary_size(x: Column) -> Column:
    """Digits of x; 0 for 0 has one."""
    return F.length(F.bin(x.cast("bigint"))).cast("bigint")


def unary_size(x: Column) -> Column:
    """The zeros alone, without the one that ends them."""
    return x.cast("bigint")


def gamma_size(x: Column) -> Column:
    return (2 * binary_size(x + 1) - 1).cast("bigint")


def delta_size(x: Column) -> Column:
    b = binary_size(x + 1)
    return (gamma_size(b - 1) + b - 1).cast("bigint")


def fixed(x: Column, width: int) -> Column:
    return _low(x, width)


def unary(x: Column) -> Column:
    """x zeros, then a one."""
    return F.concat(F.repeat(F.lit("0"), x.cast("int")), F.lit("1"))


def binary(x: Column, most: int) -> Column:
    """x up to ``most`` in as many digits as ``most`` needs; a greater x is null."""
    return F.when(x <= most, _low(x, most.bit_length()))


def gamma(x: Column) -> Column:
    b = _top(x + 1)
    return F.concat(unary(b), _low(x + 1, b))


def delta(x: Column) -> Column:
    b = _top(x + 1)
    return F.concat(gamma(b), _low(x + 1, b))


def rice(x: Column, k: int) -> Column:
    """A gamma-coded quotient, then k digits of remainder."""
    return F.concat(gamma(F.shiftrightunsigned(x.cast("bigint"), k)), _low(x, k))


def stream(df: DataFrame, keys: list[str], order: str, code: Column) -> DataFrame:
    """(keys, bits): codes of each sequence joined in order."""
    d = df.select(*keys, F.struct(F.col(order).alias("i"), code.alias("c")).alias("e"))
    d = d.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return d.select(*keys, F.array_join(F.transform("e", lambda e: e["c"]), "").alias("bits"))


class BitReader:
    """Reads a string of 0 and 1 from its start."""

    def __init__(self, bits: str):
        self.bits, self.at = bits, 0

    def reset(self, at: int = 0) -> None:
        """Go to a digit of the stream."""
        if not 0 <= at <= len(self.bits):
            raise IndexError("the stream has no such digit")
        self.at = at

    def next_one(self) -> int:
        """Index of the next 1, which is read too."""
        self.unary()
        return self.at - 1

    def fixed(self, width: int) -> int:
        """Next ``width`` digits, lowest first, 0 to 64 of them; past the end raises."""
        if not 0 <= width <= 64:
            raise ValueError("a width lies between 0 and 64")
        if self.at + width > len(self.bits):
            raise IndexError("the stream ends within a code")
        part, self.at = self.bits[self.at : self.at + width], self.at + width
        return int(part[::-1], 2) if width else 0

    def unary(self) -> int:
        one = self.bits.find("1", self.at)
        if one < 0:
            raise IndexError("the stream ends within a code")
        n, self.at = one - self.at, one + 1
        return n

    def binary(self, most: int) -> int:
        return self.fixed(most.bit_length())

    def gamma(self) -> int:
        b = self.unary()
        return (self.fixed(b) | 1 << b) - 1

    def delta(self) -> int:
        b = self.gamma()
        return (self.fixed(b) | 1 << b) - 1

    def rice(self, k: int) -> int:
        q = self.gamma()
        return q << k | self.fixed(k)


def one_indices(bits: Column) -> Column:
    """Indices of a stream's ones as ARRAY<BIGINT>, read one after another."""

    @F.arrow_udf("array<bigint>")
    def run(x: pa.Array) -> pa.Array:
        out = []
        for s in x.to_pylist():
            r = BitReader((s or "").rstrip("0"))
            out.append(None if s is None else [r.next_one() for _ in range(r.bits.count("1"))])
        return pa.array(out, pa.list_(pa.int64()))

    return run(bits)


def decode(bits: Column, code: str, *args: int) -> Column:
    """All values of a stream as ARRAY<BIGINT>; code is a method of BitReader, args its parameters."""

    @F.arrow_udf("array<bigint>")
    def run(x: pa.Array) -> pa.Array:
        out = []
        for s in x.to_pylist():
            if s is None:
                out.append(None)
                continue
            r, values = BitReader(s), []
            step: Callable[..., int] = getattr(r, code)
            while r.at < len(s):
                values.append(step(*args))
            out.append(values)
        return pa.array(out, pa.list_(pa.int64()))

    return run(bits)
