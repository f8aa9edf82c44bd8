"""The driver's contract, on the smallest tables, and that nothing but the entry point knows the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from inkspan.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.SQL) <= set(catalog.QUERIES)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 50


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["clean_pipeline", "dedup_exact", "char_freq", "split_temporal", "bpe_train", "bpe_encode_native", "zip_extract"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert _rows(got) == _rows(want)


def _rows(df):
    def text(x):
        if pd.isna(x):
            return ""
        return f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


def test_engine_does_not_import_the_subpackage():
    code = "import sys; import inkspan.cli, inkspan.plans.catalog, inkspan.streaming.clean_stream; assert not any(m.startswith('inkspan.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "inkspan", tmp_path / "inkspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clean_pipeline' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); from pyspark.sql import SparkSession; import __spark_entry__ as e; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(s).count() == 50; assert e.queries()['byte_pair_counts'](s, {DATA!r}).count() > 0"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
