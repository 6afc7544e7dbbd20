import collections
import importlib.util
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    quoted = ",".join(f'"{c}"' for c in cols)
    want = collections.Counter(tuple(map(plain, r)) for r in db.sql(f"select {quoted} from ({SQL[name]})").fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_training_data_subpackage():
    root = Path(__file__).resolve().parents[1]
    for p in (root / "folioscope").rglob("*.py"):
        if "llm" not in p.parts:
            assert "from .llm" not in p.read_text() and "folioscope.llm" not in p.read_text()
    assert importlib.util.find_spec("folioscope") and subprocess.run([sys.executable, "-c", "import folioscope.plans.catalog"], cwd=root, check=True)


def test_plans_prune_and_rank_early(spark):
    plan = lambda name: catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    rrf = plan("rrf_fuse")
    assert "WindowGroupLimit" in rrf and "partial_sum" in rrf and "CartesianProduct" not in rrf
    stats = plan("token_stats")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in stats and "Python" not in stats
