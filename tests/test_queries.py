"""Registered queries of the survey's operators against their SQL, at the smallest scale."""

import duckdb
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    own = registry.QUERIES[name](spark, SF)
    other = duck.sql(registry.ORACLES[name])
    assert rows_of(own.columns, own.collect()) == rows_of(other.columns, other.fetchall())


def test_dedup_split_where_the_first_copy_has_no_label(spark, tmp_path):
    docs = [(k, f"text {k % 30}") for k in range(90)]
    marks = [(k, None if k < 20 or k % 30 == 25 else int(k % 30 < 22)) for k in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    own, other = registry.dedup_split(spark, str(tmp_path)), con.sql(registry.ORACLES["dedup_split"])
    assert rows_of(own.columns, own.collect()) == rows_of(other.columns, other.fetchall())


def test_dedup_split_shuffles_no_text(spark):
    plan = registry.dedup_split(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Project [doc_id" in x and "text" in x]
    assert joins and all("sha2(" in x or "struct(" in x for x in joins)


def test_lexical_hits_hold_the_verbatim_passages(spark, duck):
    pairs = duck.sql("SELECT item_id, doc_id FROM benchmark AS b JOIN documents AS d ON contains(d.text, b.text)").fetchall()
    hits = {(x.question_id, x.id) for x in registry.bm25_topk(spark, SF).collect()}
    assert pairs and all(x in hits for x in pairs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
