"""Runs, ordered views, succinct structures and codes."""

import bisect
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.operators import codes, ordered, runs, succinct


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_value_runs(spark):
    """A frequent value, nulls and an empty table; searches give the same from elements and from runs."""
    r = random.Random(2)
    values = [7] * 500 + [r.randrange(40) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    found, ordered_values = succinct.value_runs(df), sorted(values)
    assert {r.v: (r.first, r.last) for r in found.collect()} == {v: (ordered_values.index(v), len(ordered_values) - 1 - ordered_values[::-1].index(v)) for v in values}
    seq = succinct.elias_fano(df)
    assert [r.v for r in seq.orderBy("idx").collect()] == ordered_values
    q = spark.createDataFrame([(s,) for s in range(-1, 42)], "s long")
    for find in (succinct.find_less, succinct.find_greater):
        for once in (False, True):
            assert sorted(find(found, q, ignore_duplicates=once).collect()) == sorted(find(seq, q, ignore_duplicates=once).collect())
    assert succinct.value_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("cuts", [[], [5], list(range(0, 900, 7)), list(range(200))])
def test_blocks_by_binary_search(spark, cuts):
    from strandloom.operators.ordered import block_of

    got = spark.range(-3, 950, 1).select("id", block_of(F.col("id"), cuts)).collect()
    assert all(b == sum(c < v for c in cuts) for v, b in got)


def test_run_lengths(spark):
    values = [0] * 10 + [1] * 8 + [2] + [3] * 11
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)] + [(1, 0, None), (1, 1, None), (1, 2, 5)], "g int, i int, v int")
    r = runs.run_lengths(df, ["g"], ["i"], "v")
    assert [tuple(x) for x in r.orderBy("g", "start").collect()] == [(0, 0, 0, 10), (0, 10, 1, 8), (0, 18, 2, 1), (0, 19, 3, 11), (1, 0, None, 2), (1, 2, 5, 1)]
    assert runs.expand_runs(r, ["g"]).count() == df.count()
    assert runs.unique_neighbours(df, ["g"], ["i"], "v").count() == 6
    assert runs.run_lengths(df.limit(0), ["g"], ["i"], "v").count() == 0


def test_ordered_views(spark):
    r = random.Random(1)
    keys = r.sample(range(10_000), 500)
    df = spark.createDataFrame([(k, r.randrange(-50, 50)) for k in keys], "k long, x long")
    want, total, before = [], 0, 0
    for i, (k, x) in enumerate(sorted(map(tuple, df.collect()))):
        total += x
        want.append((k, total, x - before, i))
        before = x
    got = {}
    for name, f in (("p", lambda: ordered.prefix_sum(df, "k", "x", out="o", blocks=7)), ("d", lambda: ordered.delta(df, "k", "x", "o", 7)), ("i", lambda: ordered.global_index(df, "k", out="o", blocks=7))):
        got[name] = dict(map(tuple, f().select("k", "o").collect()))
    assert want == [(k, got["p"][k], got["d"][k], got["i"][k]) for k, *_ in want]
    assert ordered.global_index(df.limit(0), "k").count() == 0


def test_elias_fano_known_values(spark):
    for values, s, want in (([2] * 7 + [6] * 5 + [13] * 6, 6, (6, 12, 0, 17)), ([2, 2, 4, 6], 5, (2, 3, 2, 3)), ([5, 16, 23, 33, 41], 17, (1, 2, 1, 2))):
        seq = succinct.elias_fano(spark.createDataFrame([(v,) for v in values], "v long"))
        q = spark.createDataFrame([(s,), (-1,), (99,)], "s long")
        got = [dict(map(tuple, f.collect())) for f in (succinct.find_less(seq, q), succinct.find_greater(seq, q), succinct.find_less(seq, q, ignore_duplicates=True), succinct.find_greater(seq, q, ignore_duplicates=True))]
        assert tuple(g[s] for g in got) == want
        assert got[0][-1] == -1 and got[1][99] == len(values)
    with pytest.raises(Exception, match="ascending"):
        succinct.elias_fano(spark.createDataFrame([(0, 5), (1, 3)], "o long, v long"), "v", "o").collect()


def test_lookup_is_exact(spark):
    r = random.Random(2)
    values = sorted(r.randrange(3000) for _ in range(800))
    seq = succinct.elias_fano(spark.createDataFrame([(v,) for v in values], "v long"))
    q = [(s,) for s in range(-2, 3003, 7)]
    df = spark.createDataFrame(q, "s long")
    assert rows(succinct.find_less(seq, df)) == [(s, bisect.bisect_left(values, s) - 1) for (s,) in q]
    assert rows(succinct.find_greater(seq, df)) == [(s, bisect.bisect_right(values, s)) for (s,) in q]


def test_rank_and_select(spark):
    r = random.Random(4)
    ones = sorted(r.sample(range(2000), 300))
    df = spark.createDataFrame([(p,) for p in ones], "pos long")
    q = list(range(0, 2000, 13))
    assert rows(succinct.rank(df, spark.createDataFrame([(i,) for i in q], "i long"))) == [(i, bisect.bisect_left(ones, i), i - bisect.bisect_left(ones, i)) for i in q]
    zeros = sorted(set(range(2400)) - set(ones))
    got = {t[0]: (t[1], t[2]) for t in succinct.select(df, spark.createDataFrame([(j,) for j in q], "j long")).collect()}
    assert got == {j: (ones[j] if j < len(ones) else None, zeros[j] if j < len(zeros) else j + len(ones)) for j in q}
    words = succinct.bit_words(df)
    assert [p for (p,) in rows(succinct.one_positions(words))] == ones
    assert tuple(succinct.vector_sizes(words, 2000).first()) == (2000, 300, 1700)
    assert sum(bin(w % 2**64).count("1") for _, w in succinct.all_ones(spark, 130).collect()) == 130


@pytest.mark.parametrize("width", [1, 5, 7, 13, 32, 33, 63, 64])
def test_packed_integers(spark, width):
    r = random.Random(width)
    values = [r.randrange(2 ** min(width, 63)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x long")
    words = succinct.pack_words(df, width)
    assert words.count() <= -(-100 * width // 64)
    assert [x for _, x in rows(succinct.unpack_words(words, df.select("i"), width))] == values


def test_packed_limits(spark):
    df = spark.createDataFrame([(0, 8)], "i long, x long")
    with pytest.raises(Exception, match="exceeds"):
        succinct.pack_words(df, 3).collect()
    with pytest.raises(ValueError):
        succinct.pack_words(df, 65)


def test_fixed_width_known_bytes(spark):
    df = spark.range(10)
    bits = codes.stream(df.withColumn("g", F.lit(0)), ["g"], "id", codes.fixed(F.col("id"), 5)).first().bits
    bits = bits.ljust(56, "0")
    assert [int(bits[i : i + 8][::-1], 2) for i in range(0, 56, 8)] == [32, 136, 65, 138, 57, 40, 1]


def test_codes_round_trip(spark):
    values = [0, 1, 2, 3, 7, 8, 1000, 2**31, 2**40 + 5]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "g int, i int, x long")
    x = F.col("x")
    for code, name, args in ((codes.gamma(x), "gamma", ()), (codes.delta(x), "delta", ()), (codes.rice(x, 3), "rice", (3,)), (codes.fixed(x, 48), "fixed", (48,)), (codes.binary(x, 2**41), "binary", (2**41,))):
        s = codes.stream(df, ["g"], "i", code)
        assert s.select(codes.decode(F.col("bits"), name, *args)).first()[0] == values
    sizes = df.select(F.length(codes.gamma(x)), codes.gamma_size(x), F.length(codes.delta(x)), codes.delta_size(x)).collect()
    assert all(a == b and c == d for a, b, c, d in sizes)


@given(st.lists(st.integers(0, 10**6), max_size=20))
@settings(max_examples=50, deadline=None)
def test_reader_reads_what_a_model_writes(values):
    def gamma(v):
        b = (v + 1).bit_length() - 1
        return "0" * b + "1" + "".join(str((v + 1) >> i & 1) for i in range(b))

    r = codes.BitReader("".join(map(gamma, values)))
    assert [r.gamma() for _ in values] == values and r.at == len(r.bits)


def test_reader_limits():
    with pytest.raises(ValueError):
        codes.BitReader("1" * 70).fixed(65)
    with pytest.raises(IndexError):
        codes.BitReader("0001").fixed(5)
    with pytest.raises(IndexError):
        codes.BitReader("000").unary()
