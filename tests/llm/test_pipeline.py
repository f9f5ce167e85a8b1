import brute
import duckdb
import pytest
from conftest import hard_rows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against a plain version over its own input."""
    import corpus_pipeline as p
    from sentloom.llm import decontamination, quality

    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {d for d, _ in rows}
            break
        assert out.columns == columns
        got = {r["doc_id"] for r in out.collect()}
        if name == "quality":
            model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            exp = {r["doc_id"] for r in quality.score(docs, model).where("score >= 0.3").collect()}
        elif name == "exact_dedup":
            exp = {x[0] for x in brute.exact(rows) if x[3]}
        elif name == "near_dedup":
            exp = {x[0] for x in brute.near(rows) if x[3]}
        else:
            items = [t.strip() for _, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
            exp = {d for d, t in rows if not any(i in t for i in items)}
        assert got == exp and got
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run_and_edges(spark, tmp_path):
    import corpus_pipeline as p

    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = spark.createDataFrame(hard_rows(), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() > 0
    rows.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op4_line_dedup", "op5_substring_dedup", "op6_exact_dedup", "op8_near_dedup"])
def test_sql(spark, name):
    from sentloom.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    exp = c.sql(ORACLE[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    cols = sorted(exp.column_names)
    assert sorted(got.column_names) == cols
    rows = lambda t: sorted(zip(*[t.column(x).to_pylist() for x in cols]))
    assert rows(got) == rows(exp)


def test_all_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
