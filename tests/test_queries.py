"""Every query of the engine against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import pytest

from triplane import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def link(sf_dir):
    made = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        made.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return made


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, link, name):
    got = queries.QUERIES[name](spark, sf_dir)
    found = link.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(found.columns)
    pick = lambda names, row: tuple(str(row[names.index(c)]) for c in columns)
    assert sorted(pick(got.columns, r) for r in got.collect()) == sorted(pick(found.columns, r) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
