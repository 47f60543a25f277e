"""k-mers, minimizers, samples and simulation against brute force."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.functions import encoding, hashing
from strandloom.operators import kmers, minimizers, sets, simulate
from strandloom.sources import fasta, storage
from strandloom.streaming import views


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.fixture(scope="module")
def seqs():
    r = random.Random(3)
    out = [(i, "".join(r.choice("ACGTN" if r.random() < 0.1 else "ACGT") for _ in range(r.randrange(0, 80)))) for i in range(40)]
    return [*out, (40, None), (41, ""), (42, "A" * 60), (43, "acgu" * 10), (44, "ACGéT" * 6)]


def clean(s):
    return "".join({"U": "T"}.get(c, c) if c in "ACGTU" else "N" for c in (s or "").upper())


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def windows(s, k):
    s = clean(s)
    return [(s[i : i + k], i) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]


def frame(spark, seqs):
    return spark.createDataFrame(seqs, "rec long, seq string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("canonical", [False, True])
def test_kmers(spark, seqs, canonical):
    want = sorted((i, min(w, rc(w)) if canonical else w, p) for i, s in seqs for w, p in windows(s, 5))
    assert rows(kmers.kmers(frame(spark, seqs), 5, canonical=canonical)) == want


def test_kmer_edges(spark):
    df = spark.createDataFrame([(1, "ACGTA"), (2, "ACG"), (3, "AC"), (4, "ACGTNACGT"), (5, "NACG")], "rec long, seq string")
    assert [r.kmer for r in kmers.kmers(df.where("rec = 1"), 3, reference_tail=True).orderBy("position").collect()] == ["ACG", "CGT"]
    assert kmers.kmers(df.where("rec = 2"), 3, reference_tail=True).count() == 0
    assert rows(kmers.kmers_with_breaks(df.where("rec = 4"), 3).select("position", "id", F.coalesce("kmer", F.lit("-")))) == [(0, 0, "ACG"), (1, 1, "CGT"), (2, 2, "-"), (5, 3, "ACG"), (6, 4, "CGT")]
    assert rows(kmers.kmers_with_breaks(df.where("rec = 5"), 3).select("position", "id", "kmer")) == [(1, 0, "ACG")]
    assert kmers.kmers(df.where("rec > 9"), 3).count() == 0


def minima(s, k, m, seed):
    s, out = clean(s), []
    code = lambda x: int(x.translate(str.maketrans("ACGT", "0123")), 4)
    for i in range(len(s) - k + 1):
        if "N" not in s[i : i + k]:
            out.append((i, *min((hashing.murmur128(code(s[j : j + m]).to_bytes(8, "little"), seed)[0], j, code(s[j : j + m])) for j in range(i, i + k - m + 1))))
    return out  # (k-mer position, hash, position, value)


def test_minimizers_and_super_kmers(spark, seqs):
    k, m = 9, 5
    mins, supers = [], []
    for rec, s in seqs:
        n, last = 0, None
        for i, h, p, v in minima(s, k, m, 42):
            if last and last[0] == i - 1 and last[1] == p:
                supers[-1][3] += 1
            else:
                mins.append((rec, v, signed(h), p, n))
                supers.append([rec, v, p - i, 1, i])
                n += 1
            last = (i, p)
    df = frame(spark, seqs)
    assert rows(minimizers.minimizers(df, k, m)) == sorted(mins)
    assert rows(minimizers.super_kmers(df, k, m)) == sorted(map(tuple, supers))


def test_syncmers(spark, seqs):
    want = sorted((rec, i, p - i) for rec, s in seqs for i, _, p, _ in minima(s, 9, 5, 0) if p - i in (0, 4))
    assert rows(minimizers.syncmers(frame(spark, seqs), 9, 5).select("rec", "position", "offset")) == want


def test_hash_sample(spark, seqs):
    df = frame(spark, seqs)
    assert minimizers.hash_sample(df, 5, 1.0).count() == kmers.kmers(df, 5).count()
    assert minimizers.hash_sample(df, 5, 0.0).count() == 0
    kept = {r.value for r in minimizers.hash_sample(df, 5, 0.3).collect()}
    assert all(hashing.murmur128(v.to_bytes(8, "little"), 42)[0] < 0.3 * 2**64 for v in kept) and kept
    with pytest.raises(ValueError):
        minimizers.hash_sample(df, 5, 1.5)


def test_jaccard(spark):
    a, b = spark.createDataFrame([(x,) for x in "aabbc"], "x string"), spark.createDataFrame([(x,) for x in "abbbd"], "x string")
    assert tuple(sets.jaccard(a, b, "x").first()) == (2, 4, 3, 3, 0.5)
    assert tuple(sets.jaccard(a, b, "x", multiset=True).first()) == (3, 7, 5, 5, round(3 / 7, 9))
    assert tuple(sets.jaccard(a.limit(0), b.limit(0), "x").first()) == (0, 0, 0, 0, None)


def test_random_and_mutated(spark):
    s = simulate.random_dna(spark.range(20).withColumnRenamed("id", "rec"), 300)
    base = dict(map(tuple, s.collect()))
    assert all(len(x) == 300 and set(x) <= set("ACGT") for x in base.values())
    assert dict(map(tuple, s.repartition(3).collect())) == base
    for r in simulate.mutate(s, 0.1).collect():
        assert len(r.seq) == 300 and sum(x != y for x, y in zip(r.seq, base[r.rec])) == r.substitutions
    for r in simulate.mutate(s, 0.1, 0.5, 0.4).collect():
        assert len(r.seq) == 300 + r.indel_bases
    assert {r.seq == base[r.rec] for r in simulate.mutate(s, 0.0).collect()} == {True}
    for r in simulate.mutate(s, 0.02, 1.0, 0.99, longest=7).collect():
        assert sum(int(n) for n, op in re.findall(r"(\d+)([ID])", r.cigar)) <= 7 * (r.insertions + r.deletions)  # neighbours are joined
    assert any(int(n) > 64 for r in simulate.mutate(s, 0.02, 1.0, 0.99).collect() for n, op in re.findall(r"(\d+)([ID])", r.cigar))
    with pytest.raises(ValueError):
        simulate.mutate(s, 2.0)


def test_mutations_replay(spark):
    """A cigar walks from the base sequence to the mutated one."""
    s = simulate.random_dna(spark.range(20).withColumnRenamed("id", "rec"), 300)
    base = dict(map(tuple, s.collect()))
    for r in simulate.mutate(s, 0.1, 0.5, 0.4).collect():
        at = new = 0
        for n, op in re.findall(r"(\d+)([MXID])", r.cigar):
            n = int(n)
            if op in "MX":
                assert all((x == y) == (op == "M") for x, y in zip(base[r.rec][at : at + n], r.seq[new : new + n]))
            at, new = at + n * (op != "I"), new + n * (op != "D")
        assert (at, new) == (300, len(r.seq))


def test_packed_kmers_equal_strings(spark):
    """In chunks, on breaks, canonical or not, with and without the tail."""
    df = spark.createDataFrame([(1, "ACGTNACGTTGCANNNTTTTACGATCGATCGGCTAGCTAGGATCG" * 3), (2, "AC"), (3, None), (4, ""), (5, "ACGTA")], "rec long, seq string")
    for canonical in (False, True):
        for tail in (False, True):
            want = kmers.kmers(df, 5, canonical=canonical, reference_tail=tail).select("rec", encoding.pack(F.col("kmer")), "position").collect()
            got = minimizers.packed_kmers(df, 5, canonical, tail, chunk=16).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_record_jaccard_equals_joins(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(40))) for i in range(6)] + [(6, "A"), (7, None)], "rec long, seq string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 3), (4, 6), (6, 7), (5, 99)], "a long, b long")
    for multiset in (False, True):
        want = sets.pair_jaccard(kmers.kmers(df, 3), pairs, "rec", "kmer", multiset).collect()
        got = sets.record_jaccard(minimizers.kmer_sets(df, 3, multiset=multiset), pairs).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    every = {(x.a, x.b): tuple(x) for x in sets.all_pairs_jaccard(kmers.kmers(df, 3), "rec", "kmer").collect()}
    for x in sets.pair_jaccard(kmers.kmers(df, 3), spark.createDataFrame([(i, j) for j in range(8) for i in range(j)], "a long, b long"), "rec", "kmer").collect():
        assert every.get((x.a, x.b)) == (tuple(x) if x.i else None)


def test_parameters():
    assert kmers.parameters(15, 10, True) == {"k": 15, "m": 10, "canonical": True, "bits": 30, "window": 6}
    with pytest.raises(ValueError):
        kmers.parameters(5, 6)


def test_fasta(spark, tmp_path):
    text = ">a first one\nACGT\nAC\n\n>b\nGG\n>c\tx > y\nTT\n"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    want = [("a", "first one", "ACGTAC"), ("b", None, "GG"), ("c", "x > y", "TT")]
    for name in ("a.fa", "b.fa.gz"):
        got = fasta.read_fasta(spark, f"file://{tmp_path}/{name}").select("name", "comment", "seq").collect()
        assert sorted(map(tuple, got), key=str) == want
    fasta.write_fasta(spark.createDataFrame(want, "name string, comment string, seq string"), f"file://{tmp_path}/out", 4)
    assert sorted(map(tuple, fasta.read_fasta(spark, f"file://{tmp_path}/out").select("name", "comment", "seq").collect()), key=str) == want


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 c\nACG\n+\n@@@\n@r2\nT\n+r2\nI\n")
    assert sorted(map(tuple, fasta.read_fastq(spark, f"file://{tmp_path}/a.fq").collect())) == [("r1", "c", "ACG", "@@@"), ("r2", None, "T", "I")]
    (tmp_path / "many.fq").write_text("@r1 c\nACG\nTA\n+\n@@@\n+I\n\n@r2\tx y\nT\n+r2\n@\n@e\n+\n")
    assert list(map(tuple, fasta.read_fastq(spark, f"file://{tmp_path}/many.fq").collect())) == [("r1", "c", "ACGTA", "@@@+I"), ("r2", "x y", "T", "@"), ("e", None, "", "")]
    (tmp_path / "bad.fq").write_text("@r1\nACG\n+\nII\n")
    with pytest.raises(Exception, match="malformed"):
        fasta.read_fastq(spark, f"file://{tmp_path}/bad.fq").collect()


def test_save_load_and_sizes(spark, tmp_path):
    df = spark.createDataFrame([([1, 2], "x", 5), ([], "", None)], "vec array<int>, str string, value int")
    storage.save(df, f"file://{tmp_path}/t")
    back = storage.load(spark, f"file://{tmp_path}/t")
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert tuple(storage.table_bytes(df).first()) == (2, (16 + 9 + 4) + (8 + 8))


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "ACGTACG"), (2, "NACG")], "rec long, seq string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("rec long, seq string").parquet(f"{tmp_path}/in")
    q = kmers.kmers(stream, 3).writeStream.format("memory").queryName("stream_kmers").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("stream_kmers").count() == 6
    q = views.per_batch(stream, lambda b: kmers.with_ids(kmers.kmers(b, 3)), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
