"""Registered queries of this subpackage against their SQL, on whole tables."""

import duckdb
import pytest

from tessera.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs_over_a_whole_table(spark, name):
    rows = queries()[name](spark, SF)
    if name == "op7_decontamination":
        assert rows.select("doc_id").distinct().count() > 0
    else:
        assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
