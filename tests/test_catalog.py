"""Registered queries against their SQL over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: DuckDB takes long over them: they run on a table of a few texts.
SLOW = {"frac_sample", "minimizer_rows", "super_kmer_rows", "syncmers_closed", "syncmers_open", "minimizer_offsets", "jaccard_tables", "jaccard_tables_multiset", "set_union", "kmer_jaccard_multiset", "minimizer_rows_canonical", "super_kmer_rows_canonical", "syncmer_values"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def _names():
    from strandloom.plans import catalog

    return sorted(catalog.oracle_sql())


def _views(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def whole():
    return DIR, _views(DIR)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """The smallest tables with 20 documents and 10 benchmark texts, an empty and a null one among the documents."""
    folder = tmp_path_factory.mktemp("few")
    con = _views(DIR)
    con.execute(f"COPY (SELECT * FROM documents ORDER BY length(text), doc_id LIMIT 18 OFFSET 60) TO '{folder}/part.parquet'")
    con.execute(f"COPY (SELECT * FROM '{folder}/part.parquet' UNION ALL SELECT -1, '', 'en', 's', 0 UNION ALL SELECT -2, NULL, 'en', 's', 0) TO '{folder}/documents.parquet'")
    con.execute(f"COPY (SELECT * FROM benchmark ORDER BY item_id LIMIT 10) TO '{folder}/benchmark.parquet'")
    os.remove(folder / "part.parquet")
    for t in TABLES:
        if t not in ("documents", "benchmark"):
            os.symlink(f"{DIR}/{t}.parquet", folder / f"{t}.parquet")
    return str(folder), _views(folder)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, whole, few, name):
    folder, duck = few if name in SLOW else whole
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=str)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_the_llm_folder(tmp_path):
    """The rest imports when llm and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kmer_jaccard' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
