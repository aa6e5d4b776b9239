"""Every query with SQL gives the rows of its SQL; the library stands without the corpus folder."""

import datetime
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quirework.plans import catalog

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    d = catalog.QUERIES[name](spark, DATA)
    cols = sorted(d.columns)
    got = sorted([norm(r[c]) for c in cols] for r in d.collect())
    if name not in catalog.SQL:
        assert got
        return
    r = duck.execute(catalog.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted([norm(row[names.index(c)]) for c in cols] for row in r.fetchall())


def test_entry_without_the_corpus_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quirework", tmp_path / "quirework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'seq_gaps' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries(); print(len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
