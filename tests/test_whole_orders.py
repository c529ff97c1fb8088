"""Queries over orders give every order to their operators."""

from __future__ import annotations

import duckdb
import pytest

from lingot import queries, queries_jobs
from lingot.operators import scan
from lingot.sources import exchange

SF = "/root/testdata/sf0.001"


@pytest.fixture
def seen(spark, monkeypatch):
    """Counts what the operators are given."""
    got = {}

    def paths(reports, column, real=exchange.patched_paths):
        got["orders"], got["reports"] = reports.selectExpr(f"size(from_json({column}, 'items array<string>').items) n").groupBy().sum("n").first()[0], reports.count()
        return real(reports, column)

    def points(manifest, classes, real=scan.entry_points):
        got["manifest"], got["classes"] = manifest.count(), classes.count()
        return real(manifest, classes)

    monkeypatch.setattr(exchange, "patched_paths", paths)
    monkeypatch.setattr(queries_jobs.J, "entry_points", points)
    return got


@pytest.mark.parametrize("name", ["s6_patched_sources", "f10_entry_points"])
def test_all_orders(spark, seen, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{SF}/orders.parquet'")
    n, most = con.sql("select count(*), max(o_orderkey) from orders").fetchall()[0]
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())
    if name == "s6_patched_sources":
        assert seen["orders"] == n and seen["reports"] >= most // 1000
    else:
        assert seen == {"manifest": n, "classes": n}
