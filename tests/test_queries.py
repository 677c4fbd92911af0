"""Every registered query against its SQL on the smallest driver tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from __spark_entry__ import entry  # noqa: E402
from pairloom.plans.registered import ORACLES, QUERIES  # noqa: E402
from compare import TABLES, rows_of, same  # noqa: E402

SF = os.environ.get("PAIRLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")

# Rows-only by nature: fitted models, the published benchmark.
WITHOUT_SQL = {"f4_logistic_grid", "f5_select_and_refit", "v7_freeze"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL - {"v7_freeze"}))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
