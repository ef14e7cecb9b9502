"""Postings by lists: every posting once, and none is shuffled when an index is built."""

import pyarrow as pa

from corpusloom.operators import index, segments

ROWS = [("d1", 1, "red", "blue red naïve"), ("d1", 2, None, ""), ("d2", 3, "x", "red red " * 40), (None, 4, "blue", "é É")]
SCHEMA = "owner string, key long, title string, body string"


def test_lists_hold_every_posting_once(spark):
    own = index.tokenised(spark.createDataFrame(ROWS, SCHEMA), ["owner", "key"], ["title", "body"])
    lists = index.listed(own, "key", "owner")
    columns = ["key", "len", "col", "pos", "term"]
    got = index.unlisted(lists.filter("term is not null"), "key").select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, index.exploded(own, ["key"]).select(columns).collect())) and len(got) == 88
    rows = lists.filter("term is null").selectExpr("inline(arrays_zip(owners, keys, lens))").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([("d1", 1, 4), ("d1", 2, 0), ("d2", 3, 81), (None, 4, 3)], key=repr)


def test_long_rows_are_cut_into_more_lists(monkeypatch):
    monkeypatch.setattr(index, "TOKENS_MOST", 3)
    cols = [[["a", "b"]], [["a"]], [["a"] * 9], [[]], [["b"]]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["o"] * 5), pa.array([2, 1, 9, 0, 1], "int32"), pa.array(cols)], ["key", "owner", "len", "cols"])
    parts = [p.to_pylist() for p in index._lists(iter([batch]))]
    assert [[k for r in p if r["term"] is None for k in r["keys"]] for p in parts] == [[1, 2], [3], [4, 5]]
    assert [(r["term"], r["keys"], r["poss"]) for r in parts[0] if r["term"]] == [("a", [1, 2], [0, 0]), ("b", [1], [1])]


def shuffled(spark):
    store, list_ = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    found = store.stageList(list_(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), list_())
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}


def test_no_posting_is_shuffled(spark, tmp_path):
    own = segments.Segments(spark, str(tmp_path / "i"), "key", "owner", ["title", "body"], buckets=4)
    before = shuffled(spark)
    own.rebuild(spark.createDataFrame(ROWS, SCHEMA))
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 40  # of 88 postings


def test_postings_are_not_sorted_for_their_buckets(spark, tmp_path):
    own = segments.Segments(spark, str(tmp_path / "i"), "key", "owner", ["title", "body"], buckets=4)
    most, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before, real = spark.conf.get(most), segments.bucket_of
    segments.bucket_of = lambda n: seen.append(spark.conf.get(most)) or real(n)
    try:
        own.rebuild(spark.createDataFrame(ROWS, SCHEMA))
    finally:
        segments.bucket_of = real
    assert seen == ["5"] and spark.conf.get(most) == before, "a writer for each bucket, and the session as it was"
