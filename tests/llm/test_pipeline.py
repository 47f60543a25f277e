"""The pipeline and each of its stages against brute force, on nulls, blanks, long texts, repeats, ties and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import mixing, packing, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_hash int, cut_id string, kept_row int, _id int"
SPACE = " \t\n\r\x0b\x0c"


def corpus(seed=5, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(1500)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k)) + "."
    texts = ["\n".join(line(r.randrange(12, 30)) for _ in range(r.randrange(4, 9))) for _ in range(n)]
    texts += [texts[0], texts[1] + "\n" + texts[2].split("\n")[0], texts[3].replace(texts[3].split()[5], "swapped", 1), "spam spam spam spam " * 30, "# * $ | " * 40, None, "", " \n\t", "\n".join(line(40) for _ in range(200))]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3] if i % 4 else "s1", len(t or ""), 1, "x", 2, 3) for i, t in enumerate(texts)]
    return [*rows, (None, texts[4], "en", "s2", 0, 1, "x", 2, 3), rows[6], rows[6]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: documents, and labels for half of them, with a null and a repeated id."""
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 7 != 0), 0) for i in range(0, 49, 2)] + [(None, 1, 0), (2, None, 1), (4, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def shape(rows):
    return Counter((r[0], r[1], r[3]) for r in rows)


def base_values(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def walked(trees, x):
    """The score of one row, tree by tree and node by node."""
    total = trees.base
    for at in trees.roots.tolist():
        while trees.left[at] != at:
            at = int(trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at])
        total += trees.value[at]
    return 1 / (1 + math.exp(-total))


def good(trees, text):
    n, _, _, _, repeat = base_values(text)
    return n >= 50 and 100 * repeat <= 50 * n and walked(trees, quality.statistics(text)[1]) >= 0.5


def test_quality_scores_and_statistics(spark, docs, folder):
    """Flattened trees give what a walk gives; statistics are those of the contract; the stage keeps what passes, unchanged."""
    trees = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(trees.roots) > 10
    for r in quality.assess(docs, trees).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    want = Counter((d, *base_values(t), round(walked(trees, quality.statistics(t)[1]), 9), good(trees, t)) for d, t, *_ in corpus())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, round(r.score, 9), r.kept) for r in quality.assess(docs, trees).collect())
    assert got == want
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    assert kept.schema == docs.schema and Counter(map(tuple, kept.collect())) == Counter(r for r in corpus() if good(trees, r[1]))


def test_monotone_features(spark, docs, folder):
    """More of a monotone feature never raises a score."""
    trees = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    x = np.array([quality.statistics(t)[1] for _, t, *_ in corpus()])
    for j, sign in enumerate(quality.MONOTONE):
        if sign:
            more = x.copy()
            more[:, j] += 0.3
            assert (trees.score(more) <= trees.score(x) + 1e-12).all()


def without_lines(rows):
    """rows after line dedup: links by exact Jaccard over all pairs of forms."""
    forms = {}
    for d, t, *_ in rows:
        for i, x in enumerate((t or "").split("\n")):
            if WORD.search(x):
                forms.setdefault(x.strip(SPACE).lower(), []).append((d is None, d or 0, i))
    names = sorted(forms)
    raw = [f.encode() for f in names]
    sets = [{b[k : k + 7] for k in range(max(1, len(b) - 6))} for b in raw]
    par = list(range(len(names)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if len(sets[i]) * 0.8 <= len(sets[j]) <= len(sets[i]) / 0.8 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    first = {}
    for i, f in enumerate(names):
        first[find(i)] = min([*forms[f], *([first[find(i)]] if find(i) in first else [])])
    keep = {f: first[find(i)] for i, f in enumerate(names)}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for i, x in enumerate(lines) if not WORD.search(x) or keep[x.strip(SPACE).lower()] == (r[0] is None, r[0] or 0, i)]
        if len(left) == len(lines):
            out.append(r)
        elif any(WORD.search(x) for x in left):
            out.append((r[0], "\n".join(left), *r[2:4], len("\n".join(left)), *r[5:]))
    return out


def one_of_each(rows):
    fps = [simhash.fingerprint(r[1]) for r in rows]
    left, out = dict.fromkeys(range(len(rows))), []
    while left:
        group, todo = [], [next(iter(left))]
        del left[todo[0]]
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if bin(fps[i] ^ fps[j]).count("1") <= 2]
            todo += near
            for j in near:
                del left[j]
        out.append(min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)))
    return out


def mixed(spark, rows):
    """rows as a mix takes them, word by word; the stream's order is that of the seeded hash."""
    h = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, doc_id long, text string")
    h = {r.i: (r.h, r.th) for r in h.select("i", F.xxhash64("doc_id", F.lit(7)).alias("h"), F.xxhash64("text").alias("th")).collect()}
    words = [WORD.findall(r[1] or "") for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[3]].append(i)
    table, block = mixing.plan([(s, sum(len(words[i]) for i in x), len(x)) for s, x in by.items()])
    out = Counter()
    for _, name, _, _, whole, run, lengths, quota, offset, _ in table:
        chosen = {s * run + (off + k) % n for s, (n, q, off) in enumerate(zip(lengths[:-1], quota[:-1], offset[:-1])) for k in range(q)}
        at = 0
        for i in sorted(by[name], key=lambda i: (h[i][0], rows[i][0] is not None, rows[i][0] or 0, len(words[i]), h[i][1])):
            n = len(words[i])
            taken = whole * n + sum(p // block in chosen for p in range(at, at + n))
            at += n
            if n:
                out[rows[i][0], rows[i][1], name] += taken // n
                if taken % n:
                    end = [m.end() for m in WORD.finditer(rows[i][1])][taken % n - 1]
                    out[rows[i][0], rows[i][1][:end], name] += 1
    return +out


def test_stages(spark, docs, folder):
    """Each stage on what the one before kept, in the order of STAGES; run() gives the last one's rows."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    trees = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in corpus() if good(trees, r[1])]
    assert rows and len(rows) < len(corpus())
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    lines = corpus_pipeline.line_dedup(spark, frame(rows), folder)
    assert lines.schema == docs.schema and Counter(map(tuple, lines.collect())) == Counter(without_lines(rows))
    rows = without_lines(rows)
    near = corpus_pipeline.near_dedup(spark, frame(rows), folder)
    assert near.schema == docs.schema and Counter(map(tuple, near.collect())) == Counter(one_of_each(rows))
    rows = one_of_each(rows)
    mix = corpus_pipeline.mix_sources(spark, frame(rows), folder)
    want = mixed(spark, rows)
    assert mix.columns == docs.columns and shape(mix.collect()) == want
    size = packing.Encoder()
    tokens = Counter()
    for (d, t, _), n in want.items():
        tokens[d] += n * (len(size.encode(t)) + 1)
    got = Counter()
    for p in corpus_pipeline.run(spark, folder).collect():
        got[p.doc_id] += p.length
    assert got == tokens


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, docs, folder, name, stage):
    out = stage(spark, docs.limit(0), folder)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_null_and_blank_texts(spark, docs, folder, name, stage):
    """Nothing but nulls and blanks: rules reject them, line dedup leaves them, near dedup keeps one, the mix has no words to take."""
    some = spark.createDataFrame([(i, t, None, None, None, 1, None, 2, 3) for i, t in [(1, None), (2, ""), (3, " \n"), (None, None)]], SCHEMA)
    got = sorted(r.doc_id or 0 for r in stage(spark, some, folder).collect())
    assert got == {"quality rules": [], "line dedup": [0, 1, 2, 3], "near dedup": [1], "mixing": []}[name]
