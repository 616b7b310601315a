"""Every query against its oracle on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.registry import ORACLES, QUERIES
import tessera.catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(frame):
    tidy = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    columns = sorted(frame.columns)
    return columns, sorted(repr([tidy(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are missing")
@pytest.mark.parametrize("name", sorted(ORACLES.keys() & QUERIES.keys()))
def test_oracle(spark, tables, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(tables.execute(ORACLES[name]).df())
