"""Fuzzy line de-duplication by MinHash, with DataFrame operations only.

A line's normal form is its trimmed lower-case text; lines without a word take no
part. Equal forms collapse first. Shingles are the form's substrings of ``K``
UTF-8 bytes (a shorter form is its own shingle). Signatures are one-permutation
MinHash: a shingle's hash falls into one of ROWS * BANDS cells, and each cell keeps
its least hash, whatever the line's length. Cells that both lines leave empty agree,
so a band agrees at least as often as ROWS independent minima would; a band without
any shingle isn't one. Hashes that are too large to be a cell's least, for the number
of shingles, are left out before: EXPECTED of each cell's are left on average, so a
cell loses its least hash with probability exp(-EXPECTED), in similar lines alike. Lines that share a band are candidates, and candidates are
linked if the exact Jaccard similarity of their shingle sets reaches the threshold.
Components of links keep the first line.

Not all pairs of a bucket are compared, but no link between components is left out:

1. Every line of a bucket is compared with its pivot, the line of least hash. Pairs that
   share one bucket only, with other lines in it, seldom link: they wait for step 2, and
   are left out if the bucket is one component by then.
2. In buckets that still hold several components, a line of each is compared with the
   most linked line and with PIVOTS others, drawn anew for each bucket.
3. In buckets that still hold several components, all lines outside the largest of
   them are compared with all lines of other components than their own. This goes
   in blocks, so a hot bucket is spread over tasks, and only pairs that may be links
   leave the join.

In steps 2 and 3, pairs are first held against a bound that is never wrong: a sketch
has the parities of the shingles that fall on each of its bits, so two sketches differ
in no more bits than the sets have shingles of their own. What passes is verified on
whole sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, discard, fresh, materialize
from strandloom.llm.components import connected_components

K, ROWS, BANDS, THRESHOLD = 7, 4, 8, 0.8
#: Shingles of a cell that are looked at, on average; bits of a hash that are ordered, the rest choose the cell.
EXPECTED, ORDERED = 3, 40
#: Longs of a parity sketch; drawn pivots of a bucket; lines of a block of a hot bucket.
WORDS, PIVOTS, BLOCK = 16, 1, 1024
#: Tasks over which a component's lines are dealt.
SALTS = 16
#: Candidate lines are looked up by a broadcast join up to this many, else by shuffling.
BROADCAST_LINES = 500_000
#: Bands whose cells are gathered in one row; divides BANDS.
TOGETHER = 2
SPACE = " \t\n\r\x0b\x0c"


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, line_no, form) for every line with a word; line_no counts all lines from 0."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    d = d.select("doc_id", "text_hash", F.col("line_no").cast("long").alias("line_no"), F.btrim("line", F.lit(SPACE)).alias("form"))
    return d.where("form <> ''").withColumn("form", F.lower("form"))


def identified(occ: DataFrame) -> DataFrame:
    """occ with the 128 bits of each form: p groups candidates, p and q together name the form."""
    return occ.withColumns({"p": F.xxhash64("form"), "q": F.xxhash64(F.lit(1), "form")})


def _shingle_count(raw: Column) -> Column:
    return F.greatest(F.octet_length(raw) - (K - 1), F.lit(1))


def shingles(raw: Column) -> Column:
    """The hashes of a form's shingles, repeats included, as an array.

    The bytes are bound to a variable first: a column would be copied for each shingle.
    """
    return F.get(F.transform(F.array(raw), lambda r: F.transform(F.sequence(F.lit(1), _shingle_count(r)), lambda i: F.xxhash64(F.substring(r, i, F.lit(K))))), 0)


def band_keys(lines: DataFrame) -> DataFrame:
    """(p, band) rows: a hash for each band of distinct (p, q, raw) lines that has a shingle.

    Lines must be hash-partitioned by (p, q), as a group-by leaves them; then there is no further shuffle.
    """
    n = _shingle_count(F.col("raw"))
    most = F.least(F.lit(1.0), F.lit(float(ROWS * BANDS * EXPECTED)) / n) * float(1 << ORDERED)
    # What is the same for all shingles of a line is computed before they are made, a hash once:
    # the filter isn't pushed below a column like task, else each hash would be computed there and again above.
    s = lines.select("p", "q", "raw", n.alias("n"), most.cast("long").alias("most"))
    s = s.select("p", "q", "raw", "most", F.explode(F.sequence(F.lit(1), "n")).alias("at"))
    s = s.select("p", "q", "most", F.xxhash64(F.substring(F.col("raw"), F.col("at"), F.lit(K))).alias("h"), F.spark_partition_id().alias("task"))
    s = s.withColumn("v", F.col("h").bitwiseAND(F.lit((1 << ORDERED) - 1))).where("v < most and task >= 0")
    cell, width = f"shiftrightunsigned(h, {ORDERED}) % {ROWS * BANDS}", ROWS * TOGETHER
    s = s.select("p", "q", "v", F.expr(f"cast({cell} div {width} as int)").alias("g"), F.expr(f"cast({cell} % {width} as int)").alias("r"))
    m = s.groupBy("p", "q", "g").agg(*[F.min(F.when(F.col("r") == r, F.col("v"))).alias(f"m{r}") for r in range(width)])

    def band(k: int) -> Column:
        cells = [f"m{ROWS * k + r}" for r in range(ROWS)]
        return F.when(F.coalesce(*cells).isNotNull(), F.xxhash64(F.col("g") * TOGETHER + k, *[F.coalesce(c, F.lit(-1)) for c in cells]))

    return m.select("p", F.explode(F.array(*[band(k) for k in range(TOGETHER)])).alias("band")).where("band is not null")


def shared_buckets(bands: DataFrame) -> DataFrame:
    """The (p, band) rows whose band has other lines too."""
    return bands.withColumn("lines", F.count("*").over(Window.partitionBy("band"))).where("lines > 1").select("p", "band")


def sketches(texts: DataFrame) -> DataFrame:
    """(p, size, w0, w1, ...): number of distinct shingles and the parity sketch of (p, raw) lines with distinct p."""
    s = texts.select("p", F.explode(F.array_distinct(shingles(F.col("raw")))).alias("h"))
    s = s.select("p", F.shiftrightunsigned("h", 50).cast("int").alias("at"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 44) & 63 as int))").alias("bit"))
    words = [F.bit_xor(F.when(F.col("at") % WORDS == w, F.col("bit")).otherwise(F.lit(0))).alias(f"w{w}") for w in range(WORDS)]
    return s.groupBy("p").agg(F.count("*").cast("int").alias("size"), *words)


def may_link(a: str, b: str, threshold: float) -> Column:
    """False only for sketched lines that can't reach the threshold; a, b: prefixes of their columns."""
    x, y = F.col(a + "size"), F.col(b + "size")
    apart = sum(F.bit_count(F.col(f"{a}w{w}").bitwiseXOR(F.col(f"{b}w{w}"))) for w in range(WORDS))
    return (x >= threshold * y - 1e-9) & (y >= threshold * x - 1e-9) & (apart <= (x + y) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _side(lines: DataFrame, side: str) -> DataFrame:
    return lines.select(*[F.col(c).alias(f"{side}_{c}") for c in lines.columns])


def likely(pairs: DataFrame, sketch: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, sizes): the pairs whose sketches allow a link, with the sum of their sets' sizes."""
    j = pairs.join(_side(sketch, "a"), F.col("a") == F.col("a_p")).join(_side(sketch, "b"), F.col("b") == F.col("b_p"))
    return j.where(may_link("a_", "b_", threshold)).select("a", "b", (F.col("a_size") + F.col("b_size")).alias("sizes"))


def similar(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose forms have a Jaccard similarity of threshold or more.

    texts: (p, raw), p distinct. pairs may have the sum of their sets' sizes.
    """
    one = lambda side: texts.select(F.col("p").alias(side), F.col("raw").alias(f"raw_{side}"))
    j = pairs.join(one("a"), "a").join(one("b"), "b")
    sizes = ["sizes"] if "sizes" in pairs.columns else []
    # A generator is a barrier: the shingles are computed once per pair, not once per use.
    j = j.select("a", "b", *sizes, F.inline(F.array(F.struct(shingles(F.col("raw_a")).alias("sa"), shingles(F.col("raw_b")).alias("sb")))))
    both = F.size(F.array_intersect("sa", "sb")).alias("both")
    if sizes:
        j = j.select("a", "b", F.inline(F.array(F.struct(both, F.col("sizes"))))).select("a", "b", "both", (F.col("sizes") - F.col("both")).alias("any"))
    else:  # both functions leave out repeats themselves
        j = j.select("a", "b", F.inline(F.array(F.struct(both, F.size(F.array_union("sa", "sb")).alias("any")))))
    return j.where(F.col("both") >= threshold * F.col("any") - 1e-9).select("a", "b")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the label of p: p itself where labels has none."""
    if labels is None:
        return rows.withColumn("label", F.col("p"))
    return rows.join(labels.select(F.col("node").alias("p"), "label"), "p", "left").withColumn("label", F.coalesce("label", "p"))


def _apart(rows: DataFrame) -> DataFrame:
    """The (p, band, label) rows of buckets that hold several labels, and more lines than a pivot and its only partner."""
    several = rows.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2")
    return rows.join(several.select("band"), "band", "left_semi")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after new links (a, b): only labels that a new link joins are looked at again."""
    if labels is None:
        return connected_components(links)
    at = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    j = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    up = connected_components(j.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b"))
    both = labels.union(up.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti"))
    j = both.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left")
    out = materialize(j.select("node", F.coalesce("up", "label").alias("label")), "line-labels")
    discard(labels, up)
    return out


def _pivots(b: DataFrame) -> DataFrame:
    """(a, b, first): every line of a bucket with the bucket's least; first: they share several buckets, or one that has no other line."""
    pivot = b.groupBy("band").agg(F.min("p").alias("pivot"), F.count("*").alias("n"))
    pairs = b.join(pivot, "band").where("p <> pivot").select(*_pair("p", "pivot"), "n")
    return pairs.groupBy("a", "b").agg(((F.count("*") > 1) | (F.min("n") <= 2)).alias("first"))


def _hubs(apart: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): a line of each label of a bucket with the bucket's most linked line and with PIVOTS drawn ones, where labels differ."""
    degree = links.select("a").union(links.select("b")).groupBy("a").count().select(F.col("a").alias("p"), "count")
    own = apart.join(degree, "p", "left")
    drawn = [F.max(F.struct(F.xxhash64("p", "band", F.lit(k)).alias("by"), "p", "label")) for k in range(PIVOTS)]
    hub = F.max(F.struct(F.coalesce("count", F.lit(0)).alias("by"), "p", "label"))
    hubs = own.groupBy("band").agg(F.array(hub, *drawn).alias("hs")).select("band", F.explode("hs").alias("h"))
    j = apart.join(hubs.select("band", F.col("h.p").alias("hub"), F.col("h.label").alias("of")), "band")
    j = j.where("label <> of").groupBy("label", "hub").agg(F.min_by("p", F.xxhash64("p", "hub")).alias("p"))
    return j.select(*_pair("p", "hub")).distinct()


def _rest(apart: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sizes): pairs of a bucket with different labels whose sketches allow a link.

    One side leaves out the bucket's largest label, so lines that are already one
    component aren't held against each other.
    """
    n = apart.groupBy("band", "label").count()
    most = n.groupBy("band").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"))
    most = most.select("band", F.col("m.label").alias("most"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = apart.join(most, "band").join(sketch, "p")
    left = _side(rows.where("label <> most").withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int")), "a")
    right = _side(rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "b")
    # Of two lines that are both on the left, the lesser one asks.
    on = (F.col("a_band") == F.col("b_band")) & (F.col("a_block") == F.col("b_block")) & (F.col("a_label") != F.col("b_label"))
    on &= (F.col("a_p") < F.col("b_p")) | (F.col("b_label") == F.col("b_most"))
    found = left.join(right, on & may_link("a_", "b_", threshold))
    return found.select(*_pair("a_p", "b_p"), (F.col("a_size") + F.col("b_size")).alias("sizes")).distinct()


def line_labels(buckets: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) of the lines p that have a link; buckets: (p, band), texts: (p, raw)."""
    verified = lambda pairs, texts: materialize(similar(pairs, texts, threshold), "line-links")
    known = lambda pairs, *done: reduce(lambda x, y: x.join(y.select("a", "b"), ["a", "b"], "left_anti"), done, pairs)
    asked = materialize(_pivots(buckets), "line-pairs")
    links = verified(asked.where("first"), texts)
    labels = _merged(None, links)
    apart = materialize(_apart(_labelled(buckets, labels)), "line-apart")
    fewer = materialize(texts.join(apart.select("p").distinct(), "p", "left_semi"), "line-texts")
    sketch = materialize(sketches(fewer), "line-sketches")
    # A pair left from step 1 that the sketches lack is in no bucket that still holds several components.
    hubs = materialize(known(_hubs(apart, links), asked).union(asked.where("not first").select("a", "b")), "line-pairs")
    more = verified(likely(hubs, sketch, threshold), fewer)
    labels = _merged(labels, more)
    still = materialize(_apart(_labelled(apart.select("p", "band"), labels)), "line-apart")
    last = verified(known(_rest(still, sketch, threshold), asked, hubs), fewer)
    labels = _merged(labels, last)
    discard(asked, fewer, sketch, links, apart, hubs, more, still, last)
    return labels


def line_components(occ: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(p, q, keep) for every line form that occurs again or is linked to another.

    occ: stored ``identified`` occurrences. keep: (doc_id, line_no, text_hash) of the
    component's first occurrence, null ids last. Should forms share p, which 64 bits
    make as good as impossible, that with the least q alone can have links.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "text_hash")
    distinct = occ.groupBy("p", "q").agg(F.min("form").cast("binary").alias("raw"))
    b = materialize(shared_buckets(band_keys(distinct)), "line-buckets")
    wanted = b.select("p").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_LINES else wanted
    texts = occ.join(wanted, "p", "left_semi").groupBy("p").agg(F.min(F.struct("q", "form")).alias("t"))
    texts = materialize(texts.select("p", "t.q", F.col("t.form").cast("binary").alias("raw")), "line-texts")
    labels = line_labels(b, texts.select("p", "raw"), threshold)
    named = texts.select("p", "q").join(labels.select(F.col("node").alias("p"), "label"), "p")
    found = occ.groupBy("p", "q").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    found = found.join(named, ["p", "q"], "left").where("n > 1 or label is not null")
    found = materialize(found.select("p", "q", "place", "label"), "line-found")
    keep = found.where("label is not null").groupBy("label").agg(F.min("place").alias("keep"))
    # A form without links is its own component; its p is no label, as labels have links.
    # A component may hold a large part of all forms: its rows are dealt over SALTS tasks, its kept line goes to each.
    dealt = found.withColumns({"key": F.coalesce("label", "p"), "salt": F.pmod("q", F.lit(SALTS)).cast("int")})
    keep = keep.select(F.col("label").alias("key"), "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = dealt.join(keep, ["key", "salt"], "left").select("p", "q", F.coalesce("keep", "place").alias("keep"))
    out = materialize(out, "line-components")
    discard(b, texts, labels, found)
    return out


def line_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, line_no, keep_doc_id, keep_line_no, kept) for every line with a word.

    keep_* name the line that its component keeps: the first by doc_id (nulls
    last), line number and text hash; kept is true for that line. Rows that
    repeat a whole document share places, so each keeps what one would. Null and
    blank texts give no row.
    """
    occ = materialize(identified(occurrences(docs, doc_id, text)), "line-places", "zstd", **{"parquet.compression.codec.zstd.level": "1"})
    o = occ.drop("form").join(line_components(occ, threshold), ["p", "q"], "left")
    own = F.col("keep").isNull() | ((F.col("keep.line_no") == F.col("line_no")) & F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.text_hash") == F.col("text_hash")))
    return o.select("doc_id", "text_hash", "line_no", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_doc_id"), F.coalesce("keep.line_no", "line_no").alias("keep_line_no"), own.alias("kept"))


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the lines that ``line_duplicates`` doesn't keep cut out of the text.

    Documents that lose all their lines with words leave; others keep their
    remaining lines, blank ones included, in order. A column n_chars follows. Null
    and blank texts stay as they are; rows that repeat a whole document are all cut
    alike; columns may have any names.
    """
    did, h, gone = fresh(docs, "cut_id", "cut_hash", "cut_lines")
    d = line_duplicates(docs, doc_id, text, threshold).where("not kept")
    d = d.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias(gone))
    d = d.select(F.col("doc_id").alias(did), F.col("text_hash").alias(h), gone)
    j = docs.join(d, F.col(doc_id).eqNullSafe(F.col(did)) & (F.xxhash64(text) == F.col(h)), "left")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone).cast("array<int>"))
    kept = F.array_join(F.flatten(F.transform(F.array(lines), lambda x: F.transform(left, lambda i: F.get(x, i)))), "\n")
    j = j.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept))
    j = j.where(F.col(gone).isNull() | F.col(text).rlike(WORD))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns)
