"""Registered queries against DuckDB, and an entry that works without the optional parts."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from fernbank import queries

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 4) if math.isfinite(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(float(v), 4) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.execute(queries.ORACLE_SQL[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == names
    assert got == sorted((tuple(norm(r[at.index(c)]) for c in names) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_without_oracle(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_optional_parts(tmp_path, with_pipeline):
    """The entry works without the optional package, whether or not the file that chains its operators is there."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "fernbank", tmp_path / "fernbank", ignore=lambda d, names: ["llm"] if d.endswith("fernbank") else ["__pycache__"])
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import re, __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and not any(re.match(r'op[0-9]|pipeline', q) for q in e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
