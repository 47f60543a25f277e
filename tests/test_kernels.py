"""Kernels over blocks: what leaves them, records in parts or in several rows, and the same results as one by one."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.functions import encoding, hashing
from strandloom.operators import kmers, minimizers, sets, simulate

NAMED = ["kmer_distinct", "kmers_with_breaks", "kmer_pack", "kmers_canonical", "kmer_spectrum", "jaccard_tables", "jaccard_tables_multiset", "set_union", "minimizer_offsets", "syncmer_values", "syncmers_closed", "syncmers_open", "minimizer_rows_canonical", "minimizer_rows", "super_kmer_rows", "super_kmer_rows_canonical", "frac_sample"]
SHUFFLED = ["kmer_jaccard", "kmer_jaccard_multiset"]
DEALT = ["mutated_bases", "random_sequences"]


def nodes(plan):
    """All nodes of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    yield plan
    if name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def most(df, *metrics, total=False):
    """The greatest value, or the sum, of metrics over a query's nodes."""
    df.collect()
    found = [m.get().value() for n in nodes(df._jdf.queryExecution().executedPlan()) for k in metrics if (m := n.metrics().get(k)).isDefined()]
    return sum(found) if total else max(found, default=0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 texts of the same words and 10 benchmark texts; texts of random letters; 50 customers, all in one file."""
    d = tmp_path_factory.mktemp("kernels")
    spark.createDataFrame([(i, "the quick brown fox\n" * 60) for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, "jumps over the lazy dog " * 9) for i in range(10)], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    r = random.Random(2)
    spark.createDataFrame([(i, "".join(r.choice("abcdefghij") for _ in range(4000))) for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{d}/random/documents.parquet")
    spark.range(50).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{d}/customer.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMED)
def test_rows_stay_in_kernels(spark, folder, name):
    """About 38,000 windows; no step makes a row for each."""
    assert most(entry.queries()[name](spark, folder), "numOutputRows", "pythonNumRowsReceived") < 1500


@pytest.mark.parametrize("name", SHUFFLED)
def test_texts_are_shuffled_not_kmers(spark, folder, name):
    """160,000 letters, each text for two sides of pairs and once from the file; k-mers would take several times the bytes."""
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    try:
        got = most(entry.queries()[name](spark, folder + "/random"), "shuffleBytesWritten", total=True)
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
    assert got < 3.2 * 160_000


@pytest.mark.parametrize("name", DEALT)
def test_customers_are_dealt_over_cores(spark, folder, name):
    """One file of one row group, which a scan reads in a task."""
    df = entry.queries()[name](spark, folder)
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism


def texts():
    r = random.Random(8)
    return [(i, "".join(r.choice("ACGTNu" if r.random() < 0.2 else "ACGT") for _ in range(r.choice([0, 3, 40, 90])))) for i in range(30)] + [(50, None), (51, "ACGTé" * 9), (52, "N" * 30)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def twice(spark):
    """Sequences of which some records have several rows, one of them without a name."""
    return spark.createDataFrame([*texts(), *[(i, s[::-1]) for i, s in texts()[:12] if s], (None, "ACGTACGTTG"), (None, "ACGTACGAAA")], "rec long, seq string")


def test_distinct_kmers_of_records_with_several_rows(spark, twice):
    want = sets.unique(kmers.kmers(twice, 5), "rec", "kmer").groupBy("rec").count()
    assert rows(sets.distinct_kmers(twice, 5)) == rows(want)
    once = twice.where("rec >= 40")
    assert sets.split_repeated(once)[1] is None and rows(sets.distinct_kmers(once, 5)) == rows(want.where("rec >= 40"))


def test_bytes_are_read_as_columns(spark):
    """Cleaning in kernels and in the plan give the same sequences."""
    every = "".join(map(chr, [*range(1, 128), 0xE9, 0x130, 0x4E00, 0x1F600])) + "aCgTuU\n\r\nXyz"
    r = spark.createDataFrame([(every,)], "s string").select(encoding.clean(F.col("s")), encoding.dna_from_text(F.col("s"))).first()
    assert (encoding.clean_bytes(every.encode()).decode(), encoding.prose_bytes(every.encode()).decode()) == tuple(r)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 11, 16, 17, 31, 32])
def test_packed_windows(k):
    r = random.Random(k)
    s = "".join(r.choice("ACGT" * 12 + "N") for _ in range(400))
    code = lambda x: int(x.translate(str.maketrans("ACGT", "0123")), 4)
    for canonical in (False, True):
        value, valid = minimizers.packed(s.encode(), k, canonical)
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            assert valid[i] == ("N" not in w)
            if valid[i]:
                assert int(value[i]) == (min(code(w), code(w[::-1].translate(str.maketrans("ACGT", "TGCA")))) if canonical else code(w))


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_breaks_equal_strings(spark, chunk):
    df = spark.createDataFrame(texts(), "rec long, seq string")
    for canonical in (False, True):
        want = kmers.kmers_with_breaks(df, 5, canonical=canonical).select("rec", encoding.pack(F.col("kmer")), "position", "id")
        assert rows(minimizers.packed_with_breaks(df, 5, canonical, chunk=chunk)) == rows(want)


def test_break_ids_of_records_with_several_rows(spark, tmp_path):
    t = [(1, "abcdefghijklmnop\nabcdefghijklm"), (1, "ponmlkjihgfedcba\n"), (2, "aaaaaaaaaaaaaaaaaa\n")]
    spark.createDataFrame(t, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    f = kmers.kmers_with_breaks(spark.createDataFrame(t, "rec long, text string").select("rec", encoding.dna_from_text(F.col("text")).alias("seq")), 11)
    want = f.groupBy("rec").agg(F.count("kmer"), F.count("*") - F.count("kmer"), F.sum("position"), F.sum(F.col("id") * (F.col("position") % 7)))
    assert rows(entry.queries()["kmers_with_breaks"](spark, str(tmp_path))) == rows(want)


def test_folds_equal_groups(spark, twice):
    """Parts of records and rows of a record meet; a sum beyond 64 bits raises."""
    fold = {"n": ("count", None), "total": ("sum", lambda c: c["value"]), "least": ("min", lambda c: c["value"]), "greatest": ("max", lambda c: c["position"]), "x": ("bit_xor", lambda c: c["value"])}
    want = minimizers.packed_kmers(twice, 5).groupBy("rec").agg(F.count("*"), F.sum("value"), F.min("value"), F.max("position"), F.bit_xor("value"))
    for chunk in (9, 1 << 20):
        assert rows(minimizers.packed_kmers(twice, 5, chunk=chunk, fold=fold)) == rows(want)
    with pytest.raises(Exception, match="64 bits"):
        minimizers.packed_kmers(spark.createDataFrame([(1, "T" * 40)], "rec long, seq string"), 31, fold=fold).collect()


@pytest.mark.parametrize("k", [5, 12])
def test_counts_equal_groups(spark, twice, k):
    """In a table of all values, and for more of them sorted."""
    got = minimizers.kmer_counts(twice, k, canonical=True).groupBy("value").agg(F.sum("count"))
    assert rows(got) == rows(minimizers.packed_kmers(twice, k, canonical=True).groupBy("value").count())
    assert rows(kmers.spectrum(minimizers.kmer_counts(twice, k), "value", "count")) == rows(kmers.spectrum(kmers.kmers(twice, k)))


def mutated(seq, key, rate, indel_fraction, extension, longest):
    """One sequence, base by base."""

    def draw(k, i, salt):
        z = (i * simulate.STEP + k * simulate.STEP + salt * simulate.SALT) % 2**64
        return (int(hashing.remix_np(np.array([z], np.uint64))[0]) >> 11) / 2**53

    out, ops, at, n, count = "", "", 0, len(seq), {"X": 0, "I": 0, "D": 0}
    while at < n:
        if draw(key, at, 0) >= rate:
            out, ops, at = out + seq[at], ops + "M", at + 1
            continue
        if draw(key, at, 1) >= indel_fraction:
            others = "ACGT".replace(seq[at].upper(), "")
            out, ops, at = out + others[int(draw(key, at, 4) * len(others))], ops + "X", at + 1
            count["X"] += 1
            continue
        most = n - at if longest is None else min(n - at, longest)
        more = 0 if extension == 0 else most if extension == 1 else int(math.log(1 - draw(key, at, 3)) / math.log(extension))
        length = min(most, 1 + more)
        if draw(key, at, 2) < 0.5:
            out += "".join("ACGT"[int(draw(key ^ (at + 1) * simulate.TURN, j, 5) * 4)] for j in range(length)) + seq[at]
            ops, at = ops + "I" * length + "M", at + 1
            count["I"] += 1
        else:
            ops, at = ops + "D" * length, at + length
            count["D"] += 1
    cigar = "".join(f"{len(list(g))}{op}" for op, g in itertools.groupby(ops))
    return out, count["X"], count["I"], count["D"], ops.count("I") - ops.count("D"), cigar


@pytest.mark.parametrize("how", [(0.25, 0.0, 0.0, None), (1.0, 0.0, 0.0, None), (0.3, 0.5, 0.6, None), (0.3, 1.0, 1.0, 3), (0.0, 0.5, 0.5, None)])
def test_mutations_in_blocks_equal_one_by_one(spark, monkeypatch, how):
    monkeypatch.setattr(simulate, "BLOCK", 100)
    r = random.Random(1)
    for letters in ("ACGT", "ACGTacgtN", "ACGTNß"):
        seqs = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 30, 150]))) for _ in range(12)]
        keys = np.array([r.getrandbits(64) for _ in seqs], np.uint64)
        got = [x for cols in simulate._mutated(keys, seqs, *how) for x in zip(*[c.to_pylist() for c in cols])]
        assert got == [mutated(s, k, *how) for s, k in zip(seqs, keys.tolist())]


def test_random_bases_in_blocks(spark):
    """Null, empty and long sequences among others, keys of both signs."""
    size = [5, None, 0, -3, 70_000, 7]
    df = spark.createDataFrame([(i * 1000 - 2000, n) for i, n in enumerate(size)], "rec long, n long").coalesce(1)
    for rec, n in df.collect():
        x = np.uint64((rec << 32) % 2**64) + np.arange(max(n or 0, 0), dtype=np.uint64)
        want = None if n is None else "".join("ACGT"[h] for h in (hashing.double_hash64_np(x, 42)[0] >> np.uint64(62)).tolist())
        assert simulate.random_dna(df, F.col("n")).where(F.col("rec") == rec).first().seq == want


def test_jaccard_of_counted_items(spark):
    """Parts of counts add up as multisets and count once as sets."""
    a, b = [("a", 2), ("b", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 3), ("d", 1)]
    x, y = (spark.createDataFrame(t, "x string, c long") for t in (a, b))
    assert tuple(sets.jaccard(x, y, "x", count="c").first()) == (2, 4, 3, 3, 0.5)
    assert tuple(sets.jaccard(x, y, "x", multiset=True, count="c").first()) == (3, 7, 5, 5, round(3 / 7, 9))


@pytest.mark.parametrize("multiset", [False, True])
def test_sequence_jaccard_equals_joins(spark, twice, multiset):
    """Records with several rows, without one, without a k-mer; k of one word and of two."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(32)] + [(3, 3), (5, 99), (51, 52), (50, 2)], "a long, b long")
    for k in (3, 17):
        want = sets.pair_jaccard(kmers.kmers(twice, k, canonical=True), pairs, "rec", "kmer", multiset)
        assert rows(sets.sequence_jaccard(twice, pairs, k, canonical=True, multiset=multiset)) == rows(want)


@pytest.mark.parametrize("chunk", [6, 1 << 20])
def test_minimizers_in_parts_and_by_tables(spark, monkeypatch, chunk):
    """Records cut into parts give the same rows, hashes looked up or computed too."""
    df = spark.createDataFrame(texts(), "rec long, seq string")
    whole = [rows(f) for f in (minimizers.minimizers(df, 9, 5, canonical=True, chunk=1 << 40), minimizers.minimizer_offsets(df, 9, 5, chunk=1 << 40))]
    assert whole == [rows(f) for f in (minimizers.minimizers(df, 9, 5, canonical=True, chunk=chunk), minimizers.minimizer_offsets(df, 9, 5, chunk=chunk))]
    code = minimizers._CODE[np.frombuffer("".join(s or "" for _, s in texts()).encode(), np.uint8)]
    for k, m in ((9, 5), (6, 6), (4, 1), (12, 3)):
        tables = minimizers.window_minima(code, k, m, 42, True)
        with monkeypatch.context() as p:
            p.setattr(minimizers, "TABLE_M", 0)
            assert all((x == y).all() for x, y in zip(tables, minimizers.window_minima(code, k, m, 42, True)))
    got = minimizers.offset_counts(df, 9, 5).groupBy("offset").agg(F.sum("count"))
    assert rows(got) == rows(minimizers.minimizer_offsets(df, 9, 5).groupBy("offset").count())
