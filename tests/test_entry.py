"""Driver contract: entry, every library query and its oracle at the smoke scale."""

import json
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from vintagekit.plans.oracle_sql import QUERIES as ORACLE
from vintagekit.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "decile" in df.columns


def test_every_library_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def _names(folder):
    """Names of the entry's queries and SQL in a fresh interpreter that runs in ``folder``."""
    code = "import json, __spark_entry__ as E; print(json.dumps([sorted(E.queries()), sorted(E.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return json.loads(out.stdout)


def test_entry_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(root, tmp_path / "bare", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    want = [sorted(QUERIES), sorted(ORACLE)]
    assert _names(tmp_path / "bare") == want
    shutil.copytree(root, tmp_path / "broken", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "broken" / "xxhash.py").write_text("raise ImportError('not here')")
    assert _names(tmp_path / "broken") == want


def test_oracles_can_be_stored_as_views():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    for name, sql in ORACLE.items():
        con.execute(f'CREATE VIEW "v_{name}" AS {sql}')


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    res = con.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(s_cols) == sorted(d_cols)
    assert _rows(s_cols, s_rows) == _rows(d_cols, res.fetchall())
