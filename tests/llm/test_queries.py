"""The registered queries against their SQL, and those without SQL against their contracts' row counts."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from cairnworks.llm.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, str(SF))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_input(spark, name):
    rows = QUERIES[name](spark, str(SF))
    key = "page_id" if "page_id" in rows.columns else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    got = {r[0] for r in rows.select(key).collect()}
    assert got == ids if name != "pipeline" else got < ids
