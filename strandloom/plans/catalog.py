"""The registered queries and their SQL.

Sequence queries run over whole texts of ``documents``; results are sums per
record or per value, so that a table of any size gives a comparable answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import bits, encoding, hashing
from strandloom.operators import codes, kmers, minimizers, ordered, runs, sets, simulate, succinct
from strandloom.plans import sql
from strandloom.sources import fasta, storage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

K, MK, MM = 11, 13, 8


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its scan has fewer tasks than that, as a small file has; before rows multiply."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _dna(spark: SparkSession, d: str, name: str = "documents", rec: str = "doc_id") -> DataFrame:
    texts = _spread(table(spark, d, name).select(F.col(rec).alias("rec"), "text"))
    return texts.select("rec", encoding.dna_from_text(F.col("text")).alias("seq"))


def _texts(spark: SparkSession, d: str, name: str = "documents", rec: str = "doc_id") -> DataFrame:
    """The same records by their texts, for kernels that read them with ``PROSE``."""
    return _spread(table(spark, d, name).select(F.col(rec).alias("rec"), F.col("text").alias("seq")))


PROSE = {"read": encoding.prose_bytes}


def _long(e, name: str):
    return e.cast("bigint").alias(name)


# ---- k-mers ------------------------------------------------------------------

_PER_REC = "count(*) AS n, sum(pos)::BIGINT AS positions, min(kmer) AS least, max(kmer) AS greatest"


def _of(name: str):
    return lambda c: c[name]


_COUNT, _POSITIONS, _TOTAL = ("count", None), ("sum", _of("position")), ("sum", _of("value"))
_LEAST, _GREATEST = ("min", _of("value")), ("max", _of("value"))


def _per_record(spark, d, **how) -> DataFrame:
    text = lambda v: encoding.unpack(F.col(v), K).alias(v)
    f = _kmers(spark, d, fold={"n": _COUNT, "positions": _POSITIONS, "least": _LEAST, "greatest": _GREATEST}, **how)
    return f.select("rec", "n", "positions", text("least"), text("greatest"))


def _kmers(spark, d, name: str = "documents", rec: str = "doc_id", **how) -> DataFrame:
    """Packed k-mers of a table's texts."""
    return minimizers.packed_kmers(_texts(spark, d, name, rec), K, **how, **PROSE)


def _counts(spark, d, name: str = "documents", rec: str = "doc_id") -> DataFrame:
    """Canonical ones with counts, in parts."""
    return minimizers.kmer_counts(_texts(spark, d, name, rec), K, canonical=True, **PROSE)


@_query(f"WITH dna AS ({sql.dna()}) SELECT rec, {_PER_REC} FROM ({sql.kmers(K)}) GROUP BY rec")
def kmers_forward(spark, d):
    return _per_record(spark, d)


@_query(f"WITH dna AS ({sql.dna()}), k AS (SELECT rec, pos, {sql.canonical('kmer')} AS kmer FROM ({sql.kmers(K)})) SELECT rec, {_PER_REC} FROM k GROUP BY rec")
def kmers_canonical(spark, d):
    return _per_record(spark, d, canonical=True)


@_query(f"WITH dna AS ({sql.dna()}) SELECT rec, {_PER_REC} FROM ({sql.kmers(K)}) WHERE pos + {K} < n GROUP BY rec")
def kmers_reference_tail(spark, d):
    return _per_record(spark, d, reference_tail=True)


@_query(f"""WITH dna AS ({sql.dna()}), w AS (SELECT *, lag(kmer) OVER (PARTITION BY rec ORDER BY pos) AS before FROM ({sql.windows(K)})),
r AS (SELECT rec, pos, CASE WHEN strpos(kmer, 'N') = 0 THEN kmer END AS kmer FROM w WHERE strpos(kmer, 'N') = 0 OR (strpos(kmer, 'N') = {K} AND before IS NOT NULL AND strpos(before, 'N') = 0)),
i AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS id FROM r)
SELECT rec, count(kmer) AS n, count(*) - count(kmer) AS breaks, sum(pos)::BIGINT AS positions, sum(id * (pos % 7))::BIGINT AS ids FROM i GROUP BY rec""")
def kmers_with_breaks(spark, d):
    once, several = sets.split_repeated(_texts(spark, d))
    gap = lambda c: c["value"] < 0
    fold = {"n": ("sum", lambda c: ~gap(c)), "breaks": ("sum", gap), "positions": _POSITIONS, "ids": ("sum", lambda c: c["id"] * (c["position"] % 7))}
    out = minimizers.packed_with_breaks(once, K, fold=fold, **PROSE)
    if several is None:
        return out
    # Rows of one record are numbered together.
    f = kmers.with_ids(minimizers.packed_with_breaks(several, K, **PROSE))
    return out.unionByName(f.groupBy("rec").agg(F.count("value").alias("n"), (F.count("*") - F.count("value")).alias("breaks"), _long(F.sum("position"), "positions"), _long(F.sum(F.col("id") * (F.col("position") % 7)), "ids")))


@_query(f"WITH dna AS ({sql.dna()}), k AS (SELECT kmer, count(*) AS multiplicity FROM (SELECT {sql.canonical('kmer')} AS kmer FROM ({sql.kmers(K)})) GROUP BY kmer) SELECT multiplicity, count(*) AS kmers FROM k GROUP BY multiplicity")
def kmer_spectrum(spark, d):
    return kmers.spectrum(_counts(spark, d), "value", "count")


@_query(f"WITH dna AS ({sql.dna()}) SELECT rec, count(DISTINCT kmer) AS distinct_kmers FROM ({sql.kmers(K)}) GROUP BY rec")
def kmer_distinct(spark, d):
    return sets.distinct_kmers(_texts(spark, d), K, **PROSE)


@_query(f"WITH dna AS ({sql.dna()}), p AS (SELECT rec, {sql.pack('kmer', K)} AS v FROM ({sql.kmers(K)})) SELECT rec, sum(v)::BIGINT AS packed, min(v) AS least, max(v) AS greatest FROM p GROUP BY rec")
def kmer_pack(spark, d):
    return _kmers(spark, d, fold={"packed": _TOTAL, "least": _LEAST, "greatest": _GREATEST})


@_query(f"""WITH dna AS ({sql.dna()}), parts AS (SELECT rec, unnest(string_split(s, 'N')) AS part FROM dna)
SELECT rec, sum(length(part) * (length(part) + 1) // 2)::BIGINT AS offsets, sum(length(part))::BIGINT AS bases, max(length(part))::BIGINT AS longest FROM parts WHERE part <> '' GROUP BY rec""")
def break_offsets(spark, d):
    o = kmers.break_offsets(_dna(spark, d))
    return o.groupBy("rec").agg(F.sum("offset").alias("offsets"), F.count("*").alias("bases"), F.max("offset").alias("longest"))


@_query("""WITH c AS (SELECT doc_id, regexp_replace(translate(text, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g') AS bases FROM documents)
SELECT doc_id, length(bases)::BIGINT AS n, md5(translate(bases, 'ACGTN', '01234')) AS codes, md5(bases) AS decoded, md5(translate(reverse(bases), 'ACGT', 'TGCA')) AS complement FROM c""")
def base_codes(spark, d):
    t = table(spark, d, "documents").select("doc_id", encoding.encode_text(F.col("text")).alias("c"))
    t = t.withColumn("bases", encoding.decode_text(F.col("c")))
    return t.select("doc_id", F.length("c").cast("bigint").alias("n"), F.md5("c").alias("codes"), F.md5("bases").alias("decoded"), F.md5(encoding.reverse_complement(F.col("bases"))).alias("complement"))


@_query("WITH c AS (SELECT item_id, generate_subscripts(string_split(text, ''), 1) - 1 AS i, unnest(string_split(text, '')) AS c FROM benchmark) SELECT item_id, i::INT AS i, CASE c WHEN 'A' THEN 0 WHEN 'a' THEN 0 WHEN 'C' THEN 1 WHEN 'c' THEN 1 WHEN 'G' THEN 2 WHEN 'g' THEN 2 WHEN 'T' THEN 3 WHEN 't' THEN 3 WHEN 'U' THEN 3 WHEN 'u' THEN 3 ELSE 4 END AS code FROM c")
def base_iterator(spark, d):
    """Codes of a text's characters, one after another."""
    t = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("i", "c"))
    return t.select("item_id", "i", encoding.encode_base(F.col("c")).alias("code"))


@_query(f"WITH dna AS ({sql.dna('benchmark', 'item_id')}), p AS (SELECT rec, {sql.pack_wide('kmer', 32)} AS v FROM ({sql.kmers(32)})) SELECT rec, count(*) AS n, min(v)::VARCHAR AS least, max(v)::VARCHAR AS greatest FROM p GROUP BY rec")
def kmer_pack_wide(spark, d):
    """k = 32: all 64 bits of a word."""
    p = kmers.kmers(_dna(spark, d, "benchmark", "item_id"), 32).select("rec", encoding.pack_wide(F.col("kmer")).alias("v"))
    return p.groupBy("rec").agg(F.count("*").alias("n"), F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("greatest"))


# ---- sets --------------------------------------------------------------------

_ITEMS = f"dna AS ({sql.dna()}), items AS (SELECT rec, {sql.canonical('kmer')} AS kmer FROM ({sql.kmers(K)}))"
_PAIRS = "pairs AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS b FROM (SELECT DISTINCT doc_id FROM documents) QUALIFY lead(doc_id) OVER (ORDER BY doc_id) = doc_id + 1)"


def _jaccard_sql(count: str) -> str:
    return f"""WITH {_ITEMS}, {_PAIRS}, c AS (SELECT rec, kmer, {count} AS c FROM items GROUP BY ALL), size AS (SELECT rec, sum(c)::BIGINT AS n FROM c GROUP BY rec),
i AS (SELECT a, b, sum(least(x.c, y.c))::BIGINT AS i FROM pairs JOIN c x ON x.rec = a JOIN c y ON y.rec = b AND y.kmer = x.kmer GROUP BY a, b),
t AS (SELECT p.a, p.b, coalesce(i.i, 0) AS i, coalesce(s.n, 0) AS n1, coalesce(u.n, 0) AS n2 FROM pairs p LEFT JOIN i USING (a, b) LEFT JOIN size s ON s.rec = p.a LEFT JOIN size u ON u.rec = p.b)
SELECT a, b, i, n1 + n2 - i AS u, n1, n2, CASE WHEN n1 + n2 - i > 0 THEN round(i::DOUBLE / (n1 + n2 - i), 9) END AS jaccard FROM t"""


def _neighbours(spark, d) -> DataFrame:
    """Pairs of documents with consecutive ids."""
    ids = table(spark, d, "documents").select("doc_id").distinct()
    return ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b")), "doc_id").select(F.col("doc_id").alias("a"), "b")


@_query(_jaccard_sql("1"))
def kmer_jaccard(spark, d):
    return sets.sequence_jaccard(_texts(spark, d), _neighbours(spark, d), K, canonical=True, **PROSE)


@_query(_jaccard_sql("count(*)"))
def kmer_jaccard_multiset(spark, d):
    return sets.sequence_jaccard(_texts(spark, d), _neighbours(spark, d), K, canonical=True, multiset=True, **PROSE)


def _all_pairs_sql(count: str) -> str:
    return f"""WITH dna AS ({sql.dna('benchmark', 'item_id')}), items AS (SELECT rec, {sql.canonical('kmer')} AS kmer FROM ({sql.kmers(K)})), c AS (SELECT rec, kmer, {count} AS c FROM items GROUP BY ALL), size AS (SELECT rec, sum(c)::BIGINT AS n FROM c GROUP BY rec),
i AS (SELECT x.rec AS a, y.rec AS b, sum(least(x.c, y.c))::BIGINT AS i FROM c x JOIN c y ON y.kmer = x.kmer AND x.rec < y.rec GROUP BY 1, 2)
SELECT a, b, i, s.n + t.n - i AS u, s.n AS n1, t.n AS n2, round(i::DOUBLE / (s.n + t.n - i), 9) AS jaccard FROM i JOIN size s ON s.rec = a JOIN size t ON t.rec = b"""


@_query(_all_pairs_sql("1"))
def kmer_jaccard_all(spark, d):
    """All pairs of texts that share a k-mer."""
    return sets.all_pairs_jaccard(_kmers(spark, d, "benchmark", "item_id", canonical=True), "rec", "value")


@_query(_all_pairs_sql("count(*)"))
def kmer_jaccard_all_multiset(spark, d):
    return sets.all_pairs_jaccard(_kmers(spark, d, "benchmark", "item_id", canonical=True), "rec", "value", multiset=True)


_TWO = f"dna AS ({sql.dna()}), bench AS ({sql.dna('benchmark', 'item_id')}), x AS (SELECT {sql.canonical('kmer')} AS kmer FROM ({sql.kmers(K)})), y AS (SELECT {sql.canonical('kmer')} AS kmer FROM ({sql.kmers(K, 'bench')}))"


def _whole_sql(agg: str) -> str:
    return f"""WITH {_TWO}, c AS (SELECT kmer, {agg}(p) AS p, {agg}(q) AS q FROM (SELECT kmer, 1 AS p, 0 AS q FROM x UNION ALL SELECT kmer, 0, 1 FROM y) GROUP BY kmer)
SELECT sum(least(p, q))::BIGINT AS i, sum(greatest(p, q))::BIGINT AS u, sum(p)::BIGINT AS n1, sum(q)::BIGINT AS n2, round(sum(least(p, q))::DOUBLE / sum(greatest(p, q)), 9) AS jaccard FROM c"""


def _two(spark, d) -> tuple[DataFrame, DataFrame]:
    return _counts(spark, d), _counts(spark, d, "benchmark", "item_id")


@_query(_whole_sql("max"))
def jaccard_tables(spark, d):
    return sets.jaccard(*_two(spark, d), "value", count="count")


@_query(_whole_sql("sum"))
def jaccard_tables_multiset(spark, d):
    return sets.jaccard(*_two(spark, d), "value", multiset=True, count="count")


@_query(f"WITH {_TWO}, u AS (SELECT kmer FROM x UNION SELECT kmer FROM y) SELECT substr(kmer, 1, 2) AS prefix, count(*) AS n FROM u GROUP BY 1")
def set_union(spark, d):
    return sets.set_union(*_two(spark, d), "value").groupBy(F.substring(encoding.unpack(F.col("value"), K), 1, 2).alias("prefix")).agg(F.count("*").alias("n"))


@_query(f"WITH dna AS ({sql.dna()}), k AS (SELECT rec, pos, kmer FROM ({sql.kmers(K)})) SELECT kmer, rec, pos AS position FROM k ORDER BY kmer, rec, pos LIMIT 100")
def external_sort_top(spark, d):
    """The first 100 of the sorted k-mers: the limit is the operator."""
    top = runs.sorted_prefix(_kmers(spark, d), ["value", "rec", "position"], 100)
    return top.select(encoding.unpack(F.col("value"), K).alias("kmer"), "rec", "position")


@_query("SELECT event_id, user_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS idx FROM events")
def external_sort(spark, d):
    """The whole table with its places in the order."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return runs.external_sort(e, ["value", "event_id"], storage.scratch(spark, "sort"))


@_query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events")
def unsorted_replay(spark, d):
    return runs.replay(table(spark, d, "events").select("event_id", "event_type"), "event_id", storage.scratch(spark, "replay"))


# ---- runs --------------------------------------------------------------------

_EV = "PARTITION BY user_id ORDER BY event_id"


@_query(f"""WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER ({_EV}) OR lag(event_id) OVER ({_EV}) IS NULL THEN 1 ELSE 0 END AS ch, row_number() OVER ({_EV}) - 1 AS i FROM events),
r AS (SELECT *, sum(ch) OVER ({_EV}) AS run FROM c) SELECT user_id, min(i)::BIGINT AS "start", min(event_type) AS symbol, count(*) AS length FROM r GROUP BY user_id, run""")
def rle_events(spark, d):
    return runs.run_lengths(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type")


@_query(f"SELECT user_id, row_number() OVER ({_EV}) - 1 AS i, event_type AS symbol FROM events")
def rle_expand(spark, d):
    return runs.expand_runs(rle_events(spark, d), ["user_id"])


@_query("SELECT o_orderkey, sum(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderkey)::BIGINT AS prefix FROM orders")
def prefix_sum(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("x"))
    return ordered.prefix_sum(o, "o_orderkey", "x").select("o_orderkey", "prefix")


@_query("SELECT o_orderkey, floor(o_totalprice)::BIGINT - coalesce(lag(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderkey), 0) AS delta FROM orders")
def delta(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("x"))
    return ordered.delta(o, "o_orderkey", "x").select("o_orderkey", "delta")


@_query(f"SELECT user_id, event_id, event_id - coalesce(lag(event_id) OVER ({_EV}), 0) AS delta, sum(event_id) OVER ({_EV} ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix FROM events")
def event_gaps(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return runs.cumulative(runs.differences(e, ["user_id"], ["event_id"], "event_id"), ["user_id"], ["event_id"], "event_id")


@_query(f"SELECT user_id, event_id, event_type FROM events QUALIFY lag(event_id) OVER ({_EV}) IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER ({_EV})")
def unique_neighbours(spark, d):
    return runs.unique_neighbours(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@_query("SELECT 0 AS part, r_regionkey::BIGINT AS key, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation UNION ALL SELECT 2, s_suppkey, s_name FROM supplier")
def append(spark, d):
    cols = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"))
    return runs.append(*[table(spark, d, t).select(F.col(k).cast("bigint").alias("key"), F.col(n).alias("name")) for t, k, n in cols])


@_query(f"SELECT user_id, event_id, row_number() OVER ({_EV}) - 1 AS i FROM events")
def indexed(spark, d):
    return runs.indexed(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@_query("SELECT user_id, event_id, " + ", ".join(f"{f}(event_id) OVER ({_EV} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS window_{n}" for f, n in (("sum", "sum"), ("min", "min"), ("max", "max"), ("last", "last"))) + " FROM events")
def sliding_views(spark, d):
    return runs.sliding(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "event_id", 5)


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def global_index(spark, d):
    return ordered.global_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@_query("SELECT 'events' AS what, min_by(event_type, event_id) AS front, max_by(event_type, event_id) AS back FROM events UNION ALL SELECT 'elias_fano', min(l_partkey)::VARCHAR, max(l_partkey)::VARCHAR FROM lineitem UNION ALL SELECT 'bits', '1', '1' UNION ALL SELECT 'packed', min_by(p_size, p_partkey)::VARCHAR, max_by(p_size, p_partkey)::VARCHAR FROM part")
def front_back(spark, d):
    """First and last element of a sorted table, an Elias-Fano sequence, a bit vector from its first one on, and a packed vector."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("x"))
    bit = succinct.walk(succinct.bit_words(_ones(spark, d)), 1 << 62)
    ones = bit.where("bit = 1").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    bit = bit.join(F.broadcast(ones), (F.col("pos") >= F.col("lo")) & (F.col("pos") <= F.col("hi")))  # one row
    kinds = {
        "events": runs.ends(table(spark, d, "events"), "event_id", "event_type"),
        "elias_fano": runs.ends(_seq(spark, d), "idx", "v"),
        "bits": runs.ends(bit, "pos", "bit"),
        "packed": runs.ends(succinct.unpack_words(succinct.pack_words(p, 7), p.select("i"), 7), "i", "x"),
    }
    out = [f.select(F.lit(k).alias("what"), F.col("front").cast("string").alias("front"), F.col("back").cast("string").alias("back")) for k, f in kinds.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@_query("SELECT range AS i FROM range(5, 100005, 3)")
def counting(spark, d):
    return runs.counting(spark, 5, 100005, 3)


@_query("SELECT user_id, '[' || string_agg(event_id, ', ' ORDER BY event_id) || ']' AS shown FROM events GROUP BY user_id")
def pretty_rows(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"))
    return e.select("user_id", runs.pretty(F.col("e")).alias("shown"))


@_query("SELECT * FROM (VALUES (0, 'conv_id', 'bigint', 64), (1, 'turn', 'bigint', 64), (2, 'role', 'string', NULL), (3, 'text', 'string', NULL)) v(position, name, type, bits)")
def type_names(spark, d):
    t = runs.type_names(table(spark, d, "conversations"))
    width = F.create_map(*[F.lit(x) for kv in bits.WIDTHS.items() for x in kv])
    return t.withColumn("bits", F.try_element_at(width, "type"))


# ---- hashing and sampling ----------------------------------------------------


@_query(f"WITH src AS (SELECT l_partkey, l_orderkey, l_partkey::uhugeint AS x FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)), {sql.hashed('src', 'x', 42)} SELECT l_partkey, l_orderkey, {sql.signed('h1')} AS h FROM hv")
def hash64(spark, d):
    t = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return t.withColumn("h", hashing.hash64(F.col("l_partkey"), 42))


@_query(f"WITH src AS (SELECT o_orderkey, o_orderkey::uhugeint AS x FROM orders), {sql.hashed('src', 'x', 7)} SELECT o_orderkey, {sql.signed('h1')} AS h1, {sql.signed('h2')} AS h2 FROM hv")
def double_hash64(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", hashing.double_hash64(F.col("o_orderkey"), 7).alias("h"))
    return t.select("o_orderkey", "h.h1", "h.h2")


_R1, _R2 = "13787848793156543929::uhugeint", "10723151780598845931::uhugeint"


@_query(f"""WITH a AS (SELECT o_orderkey, ((xor(o_orderkey::uhugeint, o_orderkey::uhugeint >> 30) * {_R1}) & {sql.M64}) AS z FROM orders),
b AS (SELECT o_orderkey, ((xor(z, z >> 27) * {_R2}) & {sql.M64}) AS z FROM a), c AS (SELECT o_orderkey, xor(z, z >> 31) AS z FROM b) SELECT o_orderkey, {sql.signed('z')} AS z FROM c""")
def remix(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.remix(F.col("o_orderkey")).alias("z"))


@_query(f"WITH src AS (SELECT o_orderkey, o_orderkey::uhugeint AS x FROM orders), {sql.hashed('src', 'x', 0)} SELECT o_orderkey, ((h1 * 7::uhugeint) >> 64)::BIGINT AS seven, ((h1 * 200::uhugeint) >> 64)::BIGINT AS twohundred, (((h1 & 4294967295::uhugeint) * 7::uhugeint) >> 32)::BIGINT AS low_seven FROM hv")
def fastrange(spark, d):
    h = table(spark, d, "orders").select("o_orderkey", hashing.hash64(F.col("o_orderkey"), 0).alias("h"))
    return h.select("o_orderkey", hashing.fastrange(F.col("h"), 7).alias("seven"), hashing.fastrange(F.col("h"), 200).alias("twohundred"), hashing.fastrange(F.col("h"), 7, 32).alias("low_seven"))


@_query(f"WITH src AS (SELECT o_orderkey, o_orderpriority FROM orders), {sql.hashed_bytes('src', 'o_orderpriority', 42)} SELECT o_orderkey, {sql.signed('h1')} AS h FROM hb")
def hash_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.hash_bytes(F.col("o_orderpriority"), 42).alias("h"))


@_query(f"WITH src AS (SELECT o_orderkey, o_orderkey::uhugeint * 2654435761::uhugeint AS x FROM orders), {sql.hashed_x86('src', 'x', 42)} SELECT o_orderkey, h32::BIGINT AS h32, g1::BIGINT AS h1, g2::BIGINT AS h2, g3::BIGINT AS h3, g4::BIGINT AS h4 FROM hx")
def hash_x86(spark, d):
    x = F.col("o_orderkey") * 2654435761
    t = table(spark, d, "orders").select("o_orderkey", hashing.hash32(x, 42).alias("h32"), hashing.hash128_x86(x, 42).alias("h"))
    return t.select("o_orderkey", "h32", "h.h1", "h.h2", "h.h3", "h.h4")


_RATE = 0.125


@_query(f"""WITH dna AS ({sql.dna()}), k AS (SELECT rec, pos, {sql.canonical('kmer')} AS kmer FROM ({sql.kmers(K)})), dist AS (SELECT DISTINCT kmer AS d, {sql.pack('kmer', K)}::uhugeint AS x FROM k), {sql.hashed('dist', 'x', 42)}
SELECT rec, count(*) AS n, sum(x)::BIGINT AS total, sum(pos)::BIGINT AS positions FROM k JOIN hv ON k.kmer = hv.d WHERE h1 < {int(_RATE * 2**64)}::uhugeint GROUP BY rec""")
def frac_sample(spark, d):
    return minimizers.hash_sample(_texts(spark, d), K, _RATE, fold={"n": _COUNT, "total": _TOTAL, "positions": _POSITIONS}, **PROSE)


_MINIMIZERS = {"n": _COUNT, "total": _TOTAL, "hashes": ("bit_xor", _of("hash")), "positions": _POSITIONS}
_SUPERS = {"n": _COUNT, "total": ("sum", _of("minimizer")), "offsets": ("sum", _of("mm_pos")), "kmers": ("sum", _of("size")), "starts": ("sum", lambda c: c["size"] * (c["start"] % 5))}


@_query(f"""WITH {sql.minima(MK, MM, 42)}, ch AS (SELECT *, lag(mpos) OVER (PARTITION BY rec, seg ORDER BY kpos) AS before FROM mins),
o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY kpos) - 1 AS id FROM ch WHERE before IS NULL OR before <> mpos)
SELECT rec, count(*) AS n, sum({sql.pack('mmer', MM)})::BIGINT AS total, bit_xor({sql.signed('h')}) AS hashes, sum(mpos)::BIGINT AS positions, max(id) AS last_id FROM o GROUP BY rec""")
def minimizer_rows(spark, d):
    return minimizers.minimizers(_texts(spark, d), MK, MM, fold=_MINIMIZERS | {"last_id": ("max", _of("id"))}, **PROSE)


@_query(f"""WITH {sql.minima(MK, MM, 42)}, ch AS (SELECT *, CASE WHEN lag(mpos) OVER (PARTITION BY rec, seg ORDER BY kpos) = mpos THEN 0 ELSE 1 END AS c FROM mins),
r AS (SELECT *, sum(c) OVER (PARTITION BY rec, seg ORDER BY kpos) AS run FROM ch), s AS (SELECT rec, any_value(mmer) AS mmer, min(mpos) - min(kpos) AS mm_pos, count(*) AS size, min(kpos) AS st FROM r GROUP BY rec, seg, run)
SELECT rec, count(*) AS n, sum({sql.pack('mmer', MM)})::BIGINT AS total, sum(mm_pos)::BIGINT AS offsets, sum(size)::BIGINT AS kmers, sum(size * (st % 5))::BIGINT AS starts FROM s GROUP BY rec""")
def super_kmer_rows(spark, d):
    return minimizers.super_kmers(_texts(spark, d), MK, MM, fold=_SUPERS, **PROSE)


@_query(f"""WITH {sql.minima(MK, MM, 42, True)}, ch AS (SELECT *, lag(mpos) OVER (PARTITION BY rec, seg ORDER BY kpos) AS before FROM mins)
SELECT rec, count(*) AS n, sum({sql.pack('mmer', MM)})::BIGINT AS total, bit_xor({sql.signed('h')}) AS hashes, sum(mpos)::BIGINT AS positions FROM ch WHERE before IS NULL OR before <> mpos GROUP BY rec""")
def minimizer_rows_canonical(spark, d):
    return minimizers.minimizers(_texts(spark, d), MK, MM, canonical=True, fold=_MINIMIZERS, **PROSE)


@_query(f"""WITH {sql.minima(MK, MM, 42, True)}, ch AS (SELECT *, CASE WHEN lag(mpos) OVER (PARTITION BY rec, seg ORDER BY kpos) = mpos THEN 0 ELSE 1 END AS c FROM mins),
r AS (SELECT *, sum(c) OVER (PARTITION BY rec, seg ORDER BY kpos) AS run FROM ch), s AS (SELECT rec, any_value(mmer) AS mmer, min(mpos) - min(kpos) AS mm_pos, count(*) AS size, min(kpos) AS st FROM r GROUP BY rec, seg, run)
SELECT rec, count(*) AS n, sum({sql.pack('mmer', MM)})::BIGINT AS total, sum(mm_pos)::BIGINT AS offsets, sum(size)::BIGINT AS kmers, sum(size * (st % 5))::BIGINT AS starts FROM s GROUP BY rec""")
def super_kmer_rows_canonical(spark, d):
    return minimizers.super_kmers(_texts(spark, d), MK, MM, canonical=True, fold=_SUPERS, **PROSE)


@_query(f"WITH {sql.minima(MK, MM, 0)}, k AS (SELECT rec, pos, {sql.pack(sql.canonical('kmer'), MK)} AS v FROM ({sql.kmers(MK)})) SELECT m.rec, count(*) AS n, sum(v)::BIGINT AS total FROM mins m JOIN k ON k.rec = m.rec AND k.pos = kpos WHERE mpos - kpos IN (0, {MK - MM}) GROUP BY m.rec")
def syncmer_values(spark, d):
    """Closed syncmers of either strand: the values of canonical k-mers."""
    return minimizers.syncmers(_texts(spark, d), MK, MM, canonical=True, fold={"n": _COUNT, "total": _TOTAL}, **PROSE)


def _syncmer_sql(where: str) -> str:
    return f"WITH {sql.minima(MK, MM, 0)} SELECT rec, count(*) AS n, sum(kpos)::BIGINT AS positions, sum(mpos - kpos)::BIGINT AS offsets FROM mins WHERE mpos - kpos {where} GROUP BY rec"


def _syncmers(spark, d, *offsets) -> DataFrame:
    return minimizers.syncmers(_texts(spark, d), MK, MM, *offsets, fold={"n": _COUNT, "positions": _POSITIONS, "offsets": ("sum", _of("offset"))}, **PROSE)


@_query(_syncmer_sql(f"IN (0, {MK - MM})"))
def syncmers_closed(spark, d):
    return _syncmers(spark, d)


@_query(_syncmer_sql("= 2"))
def syncmers_open(spark, d):
    return _syncmers(spark, d, 2, 2)


@_query(f"""WITH {sql.minima(MK, MM, 0)} SELECT mpos - kpos AS "offset", count(*) AS n FROM mins GROUP BY 1""")
def minimizer_offsets(spark, d):
    return minimizers.offset_counts(_texts(spark, d), MK, MM, **PROSE).groupBy("offset").agg(F.sum("count").alias("n"))


def _sampler_sql(dedup: bool) -> str:
    return f"""WITH src AS (SELECT user_id, event_id, event_id::uhugeint AS x FROM events), {sql.hashed('src', 'x', 42)},
w AS (SELECT user_id, event_id, min(h1 * 1099511627776::uhugeint + event_id::uhugeint) OVER f AS key, count(*) OVER f AS n FROM hv WINDOW f AS ({_EV} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
m AS (SELECT user_id, event_id AS e, (key % 1099511627776::uhugeint)::BIGINT AS event_id, key // 1099511627776::uhugeint AS h FROM w WHERE n = 4),
c AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY e) AS before FROM m)
SELECT user_id, event_id, {sql.signed('h')} AS hash FROM c {'WHERE before IS NULL OR before <> event_id' if dedup else ''}"""


def _sampler(spark, d, dedup: bool) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id").withColumn("h", hashing.hash64(F.col("event_id"), 42))
    return runs.sliding_minima(e, ["user_id"], "event_id", "h", 4, dedup)


@_query(_sampler_sql(True))
def minimizer_sampler(spark, d):
    return _sampler(spark, d, True)


@_query(_sampler_sql(False))
def minimizer_sampler_all(spark, d):
    return _sampler(spark, d, False)


# ---- bits --------------------------------------------------------------------


@_query("""SELECT o_orderkey, bit_count(o_orderkey)::INT AS ones, (bit_count(o_orderkey) % 2)::INT AS parity, CASE WHEN o_orderkey <> 0 THEN length(bin(o_orderkey)) - length(rtrim(bin(o_orderkey), '0')) END::INT AS lsb,
CASE WHEN o_orderkey <> 0 THEN length(bin(o_orderkey)) - 1 END::INT AS msb, lpad(bin(o_orderkey), 64, '0') AS text, reverse(lpad(bin(o_orderkey), 64, '0')) AS text_reverse FROM orders""")
def bit_scalars(spark, d):
    x = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", bits.popcount(x).cast("int").alias("ones"), bits.parity(x).cast("int").alias("parity"), bits.lsb(x).cast("int").alias("lsb"), bits.msb(x).cast("int").alias("msb"), bits.bits_text(x).alias("text"), bits.bits_text_reverse(x).alias("text_reverse"))


@_query("""WITH o AS (SELECT o_orderkey, o_orderkey % 20 AS pos, reverse(lpad(bin(o_orderkey), 64, '0')) AS b FROM orders)
SELECT o_orderkey, length(replace(substr(b, 1, pos + 1), '0', ''))::INT AS rank1, (pos + 1 - length(replace(substr(b, 1, pos + 1), '0', '')))::INT AS rank0,
list_filter(range(0, 64), lambda i: substr(b, i + 1, 1) = '1')[3]::INT AS select1, list_filter(range(0, 64), lambda i: substr(b, i + 1, 1) = '0')[3]::INT AS select0 FROM o""")
def word_rank_select(spark, d):
    x, p = F.col("o_orderkey"), F.col("o_orderkey") % 20
    return table(spark, d, "orders").select("o_orderkey", bits.word_rank1(x, p).cast("int").alias("rank1"), bits.word_rank0(x, p).alias("rank0"), bits.word_select1(x, F.lit(2)).cast("int").alias("select1"), bits.word_select0(x, F.lit(2)).cast("int").alias("select0"))


_ONES = "ones AS (SELECT DISTINCT l_orderkey AS pos FROM lineitem WHERE l_returnflag = 'R')"


def _ones(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("pos")).distinct()


@_query(f"WITH {_ONES}, w AS (SELECT pos // 64 AS block_idx, bit_or(CASE WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE (1::BIGINT << (pos % 64)::INT) END) AS word FROM ones GROUP BY 1) SELECT block_idx, word FROM w")
def bitvector_words(spark, d):
    return succinct.bit_words(_ones(spark, d))


@_query(f"WITH {_ONES} SELECT pos FROM ones")
def bitvector_ones(spark, d):
    return succinct.one_positions(succinct.bit_words(_ones(spark, d)))


@_query(f"WITH {_ONES} SELECT o_orderkey, (o_orderkey IN (SELECT pos FROM ones))::INT AS bit FROM orders")
def bitvector_at(spark, d):
    return succinct.bits_at(succinct.bit_words(_ones(spark, d)), table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "bit")


@_query(f"WITH {_ONES} SELECT max(pos) + 1 AS size, count(*) AS size1, max(pos) + 1 - count(*) AS size0 FROM ones")
def bitvector_sizes(spark, d):
    return succinct.vector_sizes(succinct.bit_words(_ones(spark, d)))


def _words_sql(ones: str) -> str:
    return f"SELECT pos // 64 AS block_idx, bit_or(CASE WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE (1::BIGINT << (pos % 64)::INT) END) AS word FROM {ones} GROUP BY 1"


@_query(f"WITH {_ONES}, n AS (SELECT max(pos) + 1 AS n FROM ones), p AS (SELECT pos, pos IN (SELECT pos FROM ones) AS bit FROM (SELECT unnest(range(0, n)) AS pos FROM n)), w AS (SELECT DISTINCT pos // 64 AS b FROM ones) SELECT pos, bit::INT AS bit FROM p WHERE pos // 64 IN (SELECT b FROM w)")
def bitvector_walk(spark, d):
    """Every bit of the words that are there, up to the last one."""
    w = succinct.bit_words(_ones(spark, d))
    size = succinct.vector_sizes(w).select("size")
    return succinct.walk(w, 1 << 62).join(F.broadcast(size), F.col("pos") < F.col("size")).drop("size")  # one row


@_query(f"""WITH {_ONES}, u AS (SELECT l_orderkey + l_linenumber AS pos, max_by((l_suppkey % 2)::INT, l_partkey * 100000 + l_suppkey) AS bit FROM lineitem GROUP BY 1),
r AS (SELECT pos FROM ones WHERE pos NOT IN (SELECT pos FROM u WHERE bit = 0) UNION SELECT pos FROM u WHERE bit = 1) {_words_sql('r')}""")
def bitvector_update(spark, d):
    """Set and clear in an order; the last counts."""
    u = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("pos"), (F.col("l_suppkey") % 2).cast("int").alias("bit"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("at"))
    return succinct.update_bits(succinct.bit_words(_ones(spark, d)), u)


@_query(f"WITH {_ONES}, r AS (SELECT pos FROM ones WHERE pos < 1001 UNION SELECT unnest(range(1001, 1500)) UNION SELECT unnest(range(1500, 5000, 1)) WHERE false) {_words_sql('r')}")
def bitvector_resize(spark, d):
    """Popped to 1001 bits, then grown to 1500 with ones, to 5000 with zeros."""
    w = succinct.resize(succinct.bit_words(_ones(spark, d)), 1 << 40, 1001)
    return succinct.resize(succinct.resize(w, 1001, 1500, 1), 1500, 5000)


@_query(f"""WITH {_ONES}, items AS (SELECT p_partkey - 1 AS i, p_partkey AS x FROM part), r AS (SELECT pos FROM ones WHERE pos < 77 UNION SELECT 77 + i * 17 + j FROM items, range(0, 17) t(j) WHERE (x >> j::INT) & 1 = 1) {_words_sql('r')}""")
def bitvector_append(spark, d):
    """17-bit blocks pushed after 77 bits."""
    w = succinct.resize(succinct.bit_words(_ones(spark, d)), 1 << 40, 77)
    return succinct.append_blocks(w, 77, table(spark, d, "part").select((F.col("p_partkey") - 1).alias("i"), F.col("p_partkey").alias("x")), 17)


@_query(f"WITH {_ONES}, w AS ({_words_sql('ones')}) SELECT block_idx, bit_count(word)::BIGINT AS ones, (sum(bit_count(word)) OVER (ORDER BY block_idx))::BIGINT AS prefix FROM w")
def popcount_prefix(spark, d):
    """Ones of each word, and up to it."""
    w = succinct.bit_words(_ones(spark, d)).select("block_idx", F.bit_count("word").cast("bigint").alias("ones"))
    return ordered.prefix_sum(w, "block_idx", "ones")


@_query(f"WITH {_ONES}, s AS (SELECT max(pos) + 1 AS bits FROM ones) SELECT bits, ((bits + 511) // 512 * 128)::BIGINT AS index_bits, round(((bits + 511) // 512 * 128)::DOUBLE / bits, 9) AS overhead FROM s")
def rank_overhead(spark, d):
    return succinct.rank_overhead(succinct.bit_words(_ones(spark, d)))


@_query(f"WITH {_ONES}, q AS (SELECT p_partkey AS start, p_partkey + p_size * 10 AS stop FROM part), r AS (SELECT start, stop, (SELECT count(*) FROM ones WHERE pos >= start AND pos < stop) AS rank1 FROM q) SELECT start, stop, rank1, stop - start - rank1 AS rank0 FROM r".replace("start", '"start"').replace("stop", '"stop"'))
def rank_ranges(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") * 10).cast("bigint").alias("stop"))
    return succinct.rank_between(_ones(spark, d), q)


@_query("WITH c AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) // 2 AS n FROM documents WHERE text <> '') SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE bit_count(unhex(substr(h, 1, 2 * n))::BIT) END::BIGINT AS rank1 FROM c WHERE n > 0")
def bytes_rank(spark, d):
    """Ones in the first half of each text's bytes."""
    t = table(spark, d, "documents").where(F.octet_length("text") > 1).select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return t.select("doc_id", bits.bytes_rank1(F.col("raw"), F.floor(F.octet_length("raw") / 2) * 8 - 1).alias("rank1"))


@_query(f"WITH {_ONES}, q AS (SELECT o_orderkey AS i FROM orders), e AS (SELECT pos AS k, 1 AS one, NULL::BIGINT AS i FROM ones UNION ALL SELECT i, 0, i FROM q), r AS (SELECT i, (sum(one) OVER (ORDER BY k, one) )::BIGINT AS c FROM e) SELECT i, coalesce(c, 0) AS rank1, i - coalesce(c, 0) AS rank0 FROM r WHERE i IS NOT NULL")
def rank(spark, d):
    return succinct.rank(_ones(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("i")))


@_query(f"""WITH {_ONES}, idx AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM ones), z AS (SELECT pos - k AS before, max(k) + 1 AS n FROM idx GROUP BY 1),
q AS (SELECT p_partkey AS j FROM part) SELECT q.j, idx.pos AS select1, q.j + coalesce(z.n, 0) AS select0 FROM q LEFT JOIN idx ON idx.k = q.j ASOF LEFT JOIN z ON q.j >= z.before""")
def select(spark, d):
    return succinct.select(_ones(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("j")))


@_query("SELECT p_partkey AS i, p_size::BIGINT AS x FROM part")
def pack_unpack(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("x"))
    return succinct.unpack_words(succinct.pack_words(p, 7), p.select("i"), 7)


@_query("SELECT p_partkey AS i, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 8191 ELSE p_size END::BIGINT AS x FROM part")
def packed_update(spark, d):
    """13-bit values, a third of them replaced."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("x"))
    new = p.where("i % 3 = 0").select("i", (F.col("i") % 8191).alias("x"))
    return succinct.unpack_words(succinct.update_packed(succinct.pack_words(p, 13), new, 13), p.select("i"), 13)


@_query("SELECT p_partkey AS i, w AS width, (p_partkey * 7919 % (1::BIGINT << (w - 1)))::BIGINT AS x FROM part, (VALUES (1), (2), (5), (31), (33), (63)) v(w)")
def pack_widths(spark, d):
    out = None
    for w in (1, 2, 5, 31, 33, 63):
        p = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.lit(w).alias("width"), (F.col("p_partkey") * 7919 % (1 << (w - 1))).alias("x"))
        u = succinct.unpack_words(succinct.pack_words(p, w), p.select("i", "width"), w)
        out = u if out is None else out.unionByName(u)
    return out


_SEQ = "seq AS (SELECT row_number() OVER (ORDER BY l_partkey) - 1 AS idx, l_partkey AS v FROM lineitem)"


def _seq(spark, d) -> DataFrame:
    return succinct.elias_fano(table(spark, d, "lineitem"), "l_partkey")


def _values(spark, d) -> DataFrame:
    """The sequence by its distinct values, which is all that a search looks at."""
    return succinct.value_runs(table(spark, d, "lineitem"), "l_partkey")


def _lookups(spark, d) -> DataFrame:
    return table(spark, d, "part").select((F.col("p_partkey") + F.col("p_size") - 20).alias("s")).distinct()


_LOOK = "q AS (SELECT DISTINCT p_partkey + p_size - 20 AS s FROM part)"


@_query(f"WITH {_SEQ}, s AS (SELECT count(*) AS n, max(v) AS universe FROM seq), l AS (SELECT *, CASE WHEN universe // (n + 1) > 1 THEN length(bin(universe // (n + 1) - 1)) ELSE 0 END::BIGINT AS low_bits FROM s) SELECT n, universe, low_bits, (n * low_bits + (universe >> low_bits::INT) + n + 1)::BIGINT AS bits FROM l")
def ef_size(spark, d):
    return succinct.elias_fano_size(_seq(spark, d))


@_query(f"WITH {_SEQ}, s AS (SELECT *, v - coalesce(lag(v) OVER (ORDER BY idx), 0) AS diff FROM seq) SELECT p_partkey AS i, v AS value, diff FROM part LEFT JOIN s ON idx = p_partkey")
def ef_access(spark, d):
    return succinct.elias_fano_at(_seq(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("i")))


_RUNS = "r AS (SELECT v, min(idx) AS f, max(idx) AS l FROM seq GROUP BY v)"


@_query(f"WITH {_SEQ}, {_RUNS}, {_LOOK} SELECT s, coalesce(l, -1) AS found FROM q ASOF LEFT JOIN r ON q.s > r.v")
def ef_lt_find(spark, d):
    return succinct.find_less(_values(spark, d), _lookups(spark, d))


@_query(f"WITH {_SEQ}, {_RUNS}, {_LOOK} SELECT s, coalesce(f, -1) AS found FROM q ASOF LEFT JOIN r ON q.s > r.v")
def ef_lt_find_unique(spark, d):
    return succinct.find_less(_values(spark, d), _lookups(spark, d), ignore_duplicates=True)


@_query(f"WITH {_SEQ}, {_RUNS}, {_LOOK} SELECT s, coalesce(f, (SELECT count(*) FROM seq)) AS found FROM q ASOF LEFT JOIN r ON q.s < r.v")
def ef_gt_find(spark, d):
    return succinct.find_greater(_values(spark, d), _lookups(spark, d))


@_query(f"WITH {_SEQ}, {_RUNS}, {_LOOK} SELECT s, coalesce(l, (SELECT count(*) FROM seq)) AS found FROM q ASOF LEFT JOIN r ON q.s < r.v")
def ef_gt_find_unique(spark, d):
    return succinct.find_greater(_values(spark, d), _lookups(spark, d), ignore_duplicates=True)


# ---- codes -------------------------------------------------------------------


@_query("""WITH p AS (SELECT p_partkey AS x, length(bin(p_partkey + 1)) AS b FROM part) SELECT x, length(bin(x))::BIGINT AS binary_size, x::BIGINT AS unary_size, (2 * b - 1)::BIGINT AS gamma_size, (2 * length(bin(b)) - 1 + b - 1)::BIGINT AS delta_size FROM p""")
def code_sizes(spark, d):
    x = F.col("p_partkey")
    return table(spark, d, "part").select(x.alias("x"), codes.binary_size(x).alias("binary_size"), codes.unary_size(x).alias("unary_size"), codes.gamma_size(x).alias("gamma_size"), codes.delta_size(x).alias("delta_size"))


def _low_sql(x: str, w: str) -> str:
    return f"substr(rpad(reverse(bin({x})), 64, '0'), 1, ({w})::INT)"


def _gamma_sql(x: str) -> str:
    return f"(repeat('0', length(bin({x} + 1)) - 1) || '1' || {_low_sql(f'({x} + 1)', f'length(bin({x} + 1)) - 1')})"


@_query(f"""WITH p AS (SELECT p_partkey, p_size::BIGINT AS x FROM part) SELECT p_partkey, {_low_sql('x', '7')} AS fixed, repeat('0', x::INT) || '1' AS unary, {_low_sql('x', '6')} AS "binary", {_gamma_sql('x')} AS gamma,
{_gamma_sql('(length(bin(x + 1)) - 1)')} || {_low_sql('(x + 1)', 'length(bin(x + 1)) - 1')} AS delta, {_gamma_sql('(x // 4)')} || {_low_sql('(x % 4)', '2')} AS rice FROM p""")
def code_strings(spark, d):
    x = F.col("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", codes.fixed(x, 7).alias("fixed"), codes.unary(x).alias("unary"), codes.binary(x, 50).alias("binary"), codes.gamma(x).alias("gamma"), codes.delta(x).alias("delta"), codes.rice(x, 2).alias("rice"))


@_query(f"SELECT p_brand, md5(string_agg({_gamma_sql('p_size::BIGINT')}, '' ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand")
def code_stream(spark, d):
    s = codes.stream(table(spark, d, "part"), ["p_brand"], "p_partkey", codes.gamma(F.col("p_size").cast("bigint")))
    return s.select("p_brand", F.md5("bits").alias("digest"))


@_query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_brand, i, p_size::BIGINT AS by_gamma, p_size::BIGINT AS by_delta, p_size::BIGINT AS by_rice FROM p")
def code_decode(spark, d):
    p, x = table(spark, d, "part"), F.col("p_size").cast("bigint")
    out = None
    for name, code, args in (("gamma", codes.gamma(x), ()), ("delta", codes.delta(x), ()), ("rice", codes.rice(x, 3), (3,))):
        s = codes.stream(p, ["p_brand"], "p_partkey", code).select("p_brand", codes.decode(F.col("bits"), name, *args).alias("v"))
        s = s.select("p_brand", F.posexplode("v").alias("i", f"by_{name}"))
        out = s if out is None else out.join(s, ["p_brand", "i"])
    return out.withColumn("i", F.col("i").cast("bigint"))


@_query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_brand, i, p_size::BIGINT AS x FROM p")
def parse_fixed(spark, d):
    """A stream of 7-bit fields read one after another."""
    s = codes.stream(table(spark, d, "part"), ["p_brand"], "p_partkey", codes.fixed(F.col("p_size").cast("bigint"), 7))
    return s.select("p_brand", F.posexplode(codes.decode(F.col("bits"), "fixed", 7)).alias("i", "x")).withColumn("i", F.col("i").cast("bigint"))


@_query("WITH p AS (SELECT *, sum(p_size + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey)::BIGINT - 1 AS one FROM part) SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY one) - 1 AS i, one FROM p")
def parse_ones(spark, d):
    """Indices of the ones of a unary stream."""
    s = codes.stream(table(spark, d, "part"), ["p_brand"], "p_partkey", codes.unary(F.col("p_size").cast("bigint")))
    return s.select("p_brand", F.posexplode(codes.one_indices(F.col("bits"))).alias("i", "one")).withColumn("i", F.col("i").cast("bigint"))


# ---- sources, storage, simulation --------------------------------------------


@_query("SELECT count(*) AS rows, sum(16 + strlen(text))::BIGINT AS bytes FROM benchmark")
def plain_size(spark, d):
    t = table(spark, d, "benchmark")
    return storage.table_bytes(t.select("item_id", "text"))


@_query("SELECT conv_id, turn, role, text, strlen(text)::BIGINT AS size FROM conversations")
def save_load(spark, d):
    path = storage.scratch(spark, "save")
    t = table(spark, d, "conversations")
    storage.save(t.select("conv_id", F.struct("turn", "role", "text").alias("said")), path)
    return storage.load(spark, path).select("conv_id", "said.turn", "said.role", "said.text", F.octet_length("said.text").cast("bigint").alias("size"))


@_query(f"WITH dna AS ({sql.dna()}) SELECT 'd' || rec AS name, 'x ' || rec AS comment, md5(s) AS digest, length(s)::BIGINT AS bases FROM dna WHERE s <> ''")
def fasta_round_trip(spark, d):
    path = storage.scratch(spark, "fasta")
    s = _dna(spark, d).where("seq <> ''")
    fasta.write_fasta(s.select(F.concat(F.lit("d"), "rec").alias("name"), F.concat(F.lit("x "), "rec").alias("comment"), "seq"), path)
    return fasta.read_fasta(spark, path).select("name", "comment", F.md5("seq").alias("digest"), F.length("seq").cast("bigint").alias("bases"))


@_query(f"WITH dna AS ({sql.dna('benchmark', 'item_id')}) SELECT 'b' || rec AS name, 'c ' || rec AS comment, md5(s) AS digest, md5(repeat('@', length(s))) AS quality FROM dna WHERE s <> ''")
def fastq_round_trip(spark, d):
    """Sequences and qualities over several lines, quality lines that begin with @ among them."""
    path = storage.scratch(spark, "fastq")
    s = _dna(spark, d, "benchmark", "item_id").where("seq <> ''")
    q = F.expr("repeat('@', length(seq))")
    fasta.write_fastq(s.select(F.concat(F.lit("b"), "rec").alias("name"), F.concat(F.lit("c "), "rec").alias("comment"), "seq", q.alias("qual")), path)
    return fasta.read_fastq(spark, path).select("name", "comment", F.md5("seq").alias("digest"), F.md5("qual").alias("quality"))


def _customers(spark, d) -> DataFrame:
    """Keys of customers, dealt over all cores whatever files and row groups hold them: sequences are much longer than keys."""
    return table(spark, d, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)


@_query(f"WITH src AS (SELECT c_custkey AS rec, range AS i, c_custkey::uhugeint * 4294967296::uhugeint + range::uhugeint AS x FROM customer, range(0, 100)), {sql.hashed('src', 'x', 42)} SELECT rec, string_agg(substr('ACGT', (h1 >> 62)::INT + 1, 1), '' ORDER BY i) AS seq FROM hv GROUP BY rec")
def random_bases(spark, d):
    """A uniform sequence of 100 bases for each customer: drawn by hash, so SQL can draw it too."""
    return simulate.random_dna(_customers(spark, d), 100, rec="c_custkey")


def _draw_sql(salt: int) -> str:
    """The draw of position i of a record with the key h1, as a number in [0, 1)."""
    z = f"((((i::uhugeint * 11400714819323198485::uhugeint) & {sql.M64}) + ((h1 * 11400714819323198485::uhugeint) & {sql.M64}) + {salt * 0xD1342543DE82EF95 % 2**64}::uhugeint) & {sql.M64})"
    for shift, by in ((30, _R1), (27, _R2)):
        z = f"((xor({z}, {z} >> {shift}) * {by}) & {sql.M64})"
    return f"((xor({z}, {z} >> 31) >> 11)::DOUBLE / 9007199254740992)"


@_query(f"""WITH src AS (SELECT c_custkey AS rec, range AS i, c_custkey::uhugeint * 4294967296::uhugeint + range::uhugeint AS x FROM customer, range(0, 60)), {sql.hashed('src', 'x', 42)},
base AS (SELECT rec, i, substr('ACGT', (h1 >> 62)::INT + 1, 1) AS c FROM hv), names AS (SELECT c_custkey AS rec, c_custkey::uhugeint AS y FROM customer), {sql.hashed('names', 'y', 42, 'hk')},
d AS (SELECT rec, i, c, {_draw_sql(0)} AS hit, {_draw_sql(4)} AS pick FROM base JOIN hk USING (rec)),
m AS (SELECT rec, i, hit < 0.25 AS s, CASE WHEN hit < 0.25 THEN substr(replace('ACGT', c, ''), floor(pick * 3)::INT + 1, 1) ELSE c END AS c FROM d)
SELECT rec, string_agg(c, '' ORDER BY i) AS seq, count(*) FILTER (s) AS substitutions FROM m GROUP BY rec""")
def mutated_bases(spark, d):
    """Substitutions drawn by hash."""
    s = simulate.random_dna(_customers(spark, d), 60, rec="c_custkey")
    return simulate.mutate(s, 0.25).select("rec", "seq", "substitutions")


@_query()
def random_sequences(spark, d):
    """A random sequence per customer, mutated. Random, so rows are compared only."""
    s = simulate.random_dna(_customers(spark, d), 200, rec="c_custkey")
    return simulate.mutate(s, 0.05, 0.3, 0.5)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
