"""Changes, resolver, stages, guarded SQL, and every registered query beside its SQL."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.operators import mutate, resolve
from corpusloom.plans import guarded
from corpusloom.queries import QUERIES, SQL
from corpusloom.streaming import ingest


def test_ratio_is_the_indel_ratio():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    for a, b in [("", ""), ("a", ""), ("kitten", "sitting"), ("abcabc", "cbacba"), ("colbert", "colbert v2"), ("x" * 100, "y" + "x" * 90)]:
        assert resolve.ratio(a, b) == pytest.approx(200 * common(a, b) / (len(a) + len(b)) if a + b else 100)


def test_resolver_tiers_and_order(spark):
    unit = lambda deg: [float(math.cos(math.radians(deg))), float(math.sin(math.radians(deg)))]
    terms = spark.createDataFrame([(1, "d", "t", "ColBERT", unit(0)), (2, "d", "t", "Dense Passage Retrieval", unit(90)), (3, "e", "t", "ColBERT", None)], "term_id long, domain string, term_type string, canonical_name string, vector array<float>")
    aliases = spark.createDataFrame([(2, "DPR")], "term_id long, alias string")
    names = [(1, "ColBERT", None, 1, 1), (2, "colbert model", None, 1, 2), (3, "dpr", None, 2, 2), (4, "Dense Passage Retrieva", None, 2, 3), (5, "zzz near", unit(80), 2, 4), (6, "qqq far", unit(40), -7, 5), (7, "qqq far", None, -7, 1), (8, "qqq-far system", None, -7, 2)]
    df = spark.createDataFrame([(o, r, "d", "t", v) for o, r, v, _, _ in names], "ord long, raw string, domain string, term_type string, vector array<float>")
    got = {r["ord"]: (r["term_id"], r["tier"]) for r in resolve.resolve(df, terms, aliases).collect()}
    assert got == {o: (t, k) for o, _, _, t, k in names}


def test_changes(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "z"), (3, "d"), (4, None)], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(mutate.insert_or_ignore(held, new, ["id"])) == [(1, "a"), (2, "b"), (3, "d"), (4, None)]
    assert rows(mutate.upsert(held, new.filter("v <> 'z' or v is null"), ["id"])) == [(1, "a"), (2, "c"), (3, "d"), (4, None)]
    assert rows(mutate.replace_all(held, new.filter("id = 2"), "id")) == [(1, "a"), (2, "c")]
    slugs = spark.createDataFrame([("a_1",), ("a_1",), ("B",), ("ok",)], "slug string")
    assert {r["slug"] for r in mutate.shared_slugs(slugs).collect()} == {"a_1", "B"}


def test_publish_swaps(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        mutate.publish(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_stream_replaces_by_key(spark, tmp_path):
    folder, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    for rows in ([(1, "a"), (2, "b")], [(1, "c")]):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(folder)
        ingest.run_stream(spark, folder, "id long, v string", "id", lambda df: df, out, point)
    assert sorted(map(tuple, ingest.latest(spark, out, "id").select("id", "v").collect())) == [(1, "c"), (2, "b")]


def test_guard(spark):
    spark.range(1500).createOrReplaceTempView("many")
    own = guarded.run(spark, "SELECT id, CAST('ab' AS BINARY) AS b FROM many ORDER BY id;", most_seconds=60)
    assert own["status"] == "ok" and own["truncated"] and len(own["rows"]) == 1000 and own["rows"][0] == {"id": 0, "b": {"_blob": True, "size_bytes": 2}}
    assert guarded.run(spark, "SELECT 1 /* ; */ -- ;\n", most_seconds=60)["status"] == "ok"
    late = guarded.run(spark, "SELECT count(*) FROM many a, many b, many c WHERE sqrt(a.id * b.id + c.id) > 1e9", most_seconds=1)
    assert late["status"] == "query_timeout"
    for sql in ("CREATE TABLE x AS SELECT 1", "EXPLAIN SELECT 1", "CALL x()", "DELETE FROM many", "CACHE TABLE many"):
        assert guarded.run(spark, sql)["status"] in ("read_only_violation", "query_failed")
    assert guarded.schema(spark, ["many", "none", "many"])["missing"] == ["none"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, datetime.datetime | datetime.date):
            return str(v)
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert sorted(duck.sql(SQL[name]).columns) == columns
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
