"""Nucleotide alphabet: cleaning, packing and reverse complements, as Columns.

A=0 C=1 G=2 T=U=3; any other character, of any script, is a break and becomes N.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(seq: Column) -> Column:
    """Upper-case ACGT, U as T, every other character N."""
    return F.regexp_replace(F.translate(seq, "acgtuU", "ACGTTT"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; string order is packed order."""
    return F.least(kmer, reverse_complement(kmer))


def encode_base(char: Column) -> Column:
    """0..3, or 4 for a break."""
    return F.translate(clean(char), "ACGTN", "01234").cast("int")


def encode_text(seq: Column) -> Column:
    """Codes of a whole sequence as a string of digits 0 to 4."""
    return F.translate(clean(seq), "ACGTN", "01234")


def decode_text(codes: Column) -> Column:
    """The sequence of a string of codes."""
    return F.translate(codes, "01234", "ACGTN")


def decode_base(code: Column) -> Column:
    return F.substring(F.lit("ACGTN"), code.cast("int") + 1, F.lit(1))


def pack(kmer: Column) -> Column:
    """Two bits a base as BIGINT, for k up to 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def pack_wide(kmer: Column) -> Column:
    """The same as DECIMAL(20,0), for k up to 32."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("decimal(20,0)")


def unpack(value: Column, k: int) -> Column:
    """The k-mer of a packed value."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


#: Letters to bases by alphabet index modulo 4; line feeds break.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "".join("ACGT"[i % 4] for i in range(26)) * 2


def dna_from_text(text: Column) -> Column:
    """A nucleotide sequence from prose, for test data without any."""
    return F.translate(F.translate(F.regexp_replace(text, "[^A-Za-z\n]", ""), LETTERS, BASES), "\n", "N")


_CLEAN = bytes({"A": 65, "C": 67, "G": 71, "T": 84, "U": 84}.get(chr(i).upper() if i < 128 else "", 78) for i in range(256))
_FOLLOWING = bytes(range(0x80, 0xC0))
_PROSE = bytes(ord(dict(zip(LETTERS, BASES)).get(chr(i), "N")) for i in range(256))
_DROPPED = bytes(i for i in range(256) if chr(i) not in LETTERS + "\n")


def clean_bytes(seq: bytes) -> bytes:
    """clean over UTF-8, in a kernel: a byte for each character."""
    return seq.translate(_CLEAN, _FOLLOWING)


def prose_bytes(text: bytes) -> bytes:
    """dna_from_text over UTF-8, in a kernel."""
    return text.translate(_PROSE, _DROPPED)
