import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import duckdb
import pandas as pd
import pytest
from actionflow.plans import oracles, queries

BASE = os.environ.get("ACTIONFLOW_TEST_TABLES", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(BASE).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else x
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_against_sql(spark, name):
    got = queries.QUERIES[name](spark, BASE).toPandas()
    if name in oracles.ORACLES:
        want = connect().execute(oracles.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(BASE)


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__spark_entry__.__file__).parent / "actionflow"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "actionflow.llm" not in p.read_text(), p


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy without them still imports, and offers all other queries; a broken import inside them isn't hidden."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(queries.QUERIES)), str(len(oracles.ORACLES)), "False", "False"]
    (tmp_path / "copy" / "actionflow" / "llm").mkdir()
    (tmp_path / "copy" / "actionflow" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in run().stderr
