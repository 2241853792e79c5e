"""Distinct solutions of joins of two tables by what is no key."""

from __future__ import annotations

import pytest

from triplane import queries
from triplane.operators import body

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, monkeypatch, name, data):
    """A query over given tables, with lists of at most about two, equals its SQL row by row."""
    monkeypatch.setattr(body, "LIST", 2)
    link = duckdb.connect()
    g = body.Graph(spark)
    for table, (columns, rows) in data.items():
        g = g.with_table(spark.createDataFrame(rows, columns), queries.MAPPINGS[table])
        link.execute(f"CREATE TABLE {table} ({columns})")
        link.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = link.execute(queries.ORACLES[name]).fetchall()
    return g, sorted(r for r in found if None not in r)  # a null key makes no triple


PARTS = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_theta_join_without_a_distinct_over_its_rows(spark, monkeypatch):
    # keys that occur twice, alike (3) and with other values (1, 7), null cells and a null key
    rows = [(1, "B1", "T", 5), (1, "B1", "T", 9), (2, "B1", "T", 4), (3, "B1", "T", 7), (3, "B1", "T", 7), (4, "B1", "T", 1), (5, "B2", "T", 3)]
    rows += [(6, "B2", "T", None), (7, "B2", "T", 8), (7, "B1", "T", 2), (8, None, "T", 1), (None, "B1", "T", 1), *((k, "B1", "T", k % 3) for k in range(20, 32))]
    g, want = against_sql(spark, monkeypatch, "cross_filter_theta", {"part": (PARTS, [(k, "n", b, t, s, 1.0) for k, b, t, s in rows])})
    pattern = [("?p", "brand", "?b"), ("?p", "partType", "?t"), ("?p", "size", "?s"), ("?q", "brand", "?b"), ("?q", "partType", "?t"), ("?q", "size", "?s2")]
    got = body.select([*pattern, body.Filter(lambda v: v.s > v.s2)], g, "p", "q")
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # no distinct over all rows


def test_path_without_a_distinct_over_its_rows(spark, monkeypatch):
    customers = [(k, f"c{k}", k % 3, 1.0, "S") for k in range(15)] + [(3, "again", 1, 1.0, "S"), (4, "c4", 1, 1.0, "S"), (5, "none", None, 1.0, "S"), (None, "null", 1, 1.0, "S")]
    suppliers = [(k, f"s{k}", k % 4, 1.0) for k in range(9)] + [(2, "again", 0, 1.0), (2, "third", 1, 1.0), (6, "s6", None, 1.0)]
    data = {"customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", customers), "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", suppliers)}
    g, want = against_sql(spark, monkeypatch, "path_group", data)
    got = body.select([body.Path("?s", ("supplierNation", "^customerNation"), "?c")], g)
    assert sorted((r.s, r.c) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    paths = body.select([body.Path("?x", ("supplierNation", "^supplierNation"), "?x")], g)
    assert sorted(r.x for r in paths.collect()) == list(range(9))
