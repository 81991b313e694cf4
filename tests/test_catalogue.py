"""Every query of the catalogue against its SQL on DuckDB."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from skarn.plans import catalogue, evidence, structure  # noqa: F401  (the others add their queries)

SF = os.environ.get("SKARN_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    a = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(map(norm, r)) for r in want.fetchall()), key=key)
    assert a == b and a
