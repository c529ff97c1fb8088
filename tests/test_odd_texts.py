"""Rewriting of texts with odd ends, spaces and letters, against SQL."""

from __future__ import annotations

import duckdb
import pytest

from lingot import queries

TEXTS = ["", "a\n", "a\nb\n\n", "\n", "gone\n" * 12 + "gone", "中文 text\nnext", "emoji 😀\nx", "a\r\nb\rc\r", "\tabc\t\n\tdef\t", " a \n  \n x=1\n=\n=x", "a=\n b = c \n", None, "x y \nz ", " z \nz　", "é\u0085\nü"]


@pytest.mark.parametrize("name", ["x5_rewrite_texts", "a8_patch_counts", "x9_publish_status"])
def test_odd_texts_are_rewritten_as_sql_says(spark, tmp_path, name):
    rows = [(12 * i + k, t, "s") for i, t in enumerate(TEXTS) for k in range(12)]
    if name == "x5_rewrite_texts":  # x9 looks for every line in the whole text
        rows.append((9_996, "\n".join(["same"] * 100_030), "s"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(map(tuple, got.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
