import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans.oracle import ORACLE
from graphloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = db.execute(ORACLE[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns and len(got)
    a, b = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, expected))
    a, b = a.astype(object), b.astype(object)
    assert ((a == b) | (a.isna() & b.isna())).all().all()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["new_idx", "v"] and sorted(r["v"] for r in df.collect()) == list(range(1000))
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_alone(tmp_path):
    """Without the training-data package and the pipeline, the entry module has the other queries."""
    root = Path(entry.__file__).parent
    for path in root.glob("graphloom/**/*.py"):
        if "llm" not in path.parts:
            to = tmp_path / path.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text(Path(entry.__file__).read_text())
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES) and sorted(e.oracle_sql()) == sorted(e.ORACLE))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.strip() == "True", out.stderr
