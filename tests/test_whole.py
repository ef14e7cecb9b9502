"""Registered queries cover their whole tables."""

from corpusloom.operators import graph
from corpusloom.queries import QUERIES


def test_outbound_has_every_source_and_a_total_order(spark, sf):
    sources = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["citations_outbound"](spark, sf).count() == sources
    rows = [(1, 1, 9, None), (1, 1, None, None), (1, 1, 7, 70), (1, 1, 8, 80), (1, None, 2, 20)]
    for own in (rows, rows[::-1]):
        got = graph.outbound(spark.createDataFrame(own, "src long, ref_number int, cited long, cited_id long").coalesce(1), most=3).collect()
        assert [tuple(r) for r in got] == [(1, 2, 1, 0, True)]


def test_nearest_has_every_query(spark, sf):
    scopes = {r["label"]: r["n"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").agg({"*": "count"}).toDF("label", "n").collect()}
    got = QUERIES["nearest_in_scope_all"](spark, sf)
    assert got.select("query_id").distinct().count() == sum(n for n in scopes.values() if n > 1)
    assert got.count() == sum(n * min(10, n - 1) for n in scopes.values())
