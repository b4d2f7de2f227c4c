"""Every registered query of the library against its SQL."""

import os

import duckdb
import pytest

from harrier.plans import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(values, names):
    def cell(v):
        return None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else str(v)

    return sorted((tuple(cell(v) for _, v in sorted(zip(names, r, strict=True))) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = db.sql(oracles.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0
