"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from sentloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "benchmark", "conversations", "labels", "pages"]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    assert got.num_rows
    if name in catalog.ORACLE:
        exp = sql.sql(catalog.ORACLE[name]).to_arrow_table()
        cols = sorted(got.column_names)
        assert cols == sorted(exp.column_names)
        rows = lambda t: sorted(zip(*[t.column(c).to_pylist() for c in cols]), key=repr)
        assert rows(got) == rows(exp)


def test_every_fiftieth_row_is_a_query(spark):
    """Whatever its label."""
    ids = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    got = [(r["qid"], r["rank"]) for r in catalog.QUERIES["batch_topk"](spark, SF).collect()]
    assert sorted(got) == [(i, k) for i in sorted(ids) for k in range(1, 11)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
