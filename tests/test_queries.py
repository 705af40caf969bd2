"""Every query of the catalogue against its SQL over the same tables."""

from pathlib import Path

import duckdb
import pytest

from quarrylens.plans.oracles import ORACLES
from quarrylens.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def test_all_have_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    if not SF.exists():
        pytest.skip("no tables")
    want = db.sql(ORACLES[name])
    cols = sorted(want.columns)
    got = QUERIES[name](spark, str(SF))
    assert sorted(got.columns) == cols
    rows = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
    order = [want.columns.index(c) for c in cols]
    assert rows == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall())))
