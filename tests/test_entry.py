import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from urban_spark.plans import QUERIES, SQL

ROOT = Path(__file__).parents[1]
DATA = Path("/root/testdata/sf0.001")
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'slice_panel_severity' in q and set(e.oracle_sql()) <= set(q); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


def test_imports_without_the_text_operators(tmp_path):
    for name in ("urban_spark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "urban_spark" / "llm", ignore_errors=True)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), "0", "False"]


def test_other_queries_outlive_a_broken_text_operator(tmp_path):
    for name in ("urban_spark", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    text = tmp_path / "urban_spark" / "llm"
    text.mkdir(exist_ok=True)
    (text / "queries.py").write_text("import a_library_that_is_not_there\n")
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split()[0] in (str(len(QUERIES)), str(len(QUERIES) + 1)) and "a_library_that_is_not_there" in out.stderr


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(QUERIES) > 200


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL)[::12])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    found = con.execute(SQL[name])
    columns = sorted(d[0] for d in found.description)
    place = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(row[i] for i in place) for row in found.fetchall()), key=repr)
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == columns
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == tuple(pytest.approx(x, rel=1e-9) if isinstance(x, float) else x for x in b)
